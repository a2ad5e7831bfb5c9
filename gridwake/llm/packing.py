"""Best-fit packing, certified by dual-feasible-function lower bounds.

Documents are tokenized and cut into pieces of at most LENGTH tokens; pieces are dealt to groups of
about GROUP_ROWS and each group is packed by best-fit decreasing. Dual-feasible functions give a
lower bound on each group's bins. Bins that a group uses beyond its bound, and its emptiest ones,
are opened: their pieces are exchanged between groups and packed again, as long as that saves bins.

Tokens come from a public vocabulary file through `tokenizers`. A word (run of bytes that are not
ASCII white space) always gets the same tokens, so each worker keeps a bounded table of them; words
of Latin letters that are not in it go through byte-pair ranks derived from the same file, all
others through `tokenizers` itself, as do whole texts that hold the string of a special token.

Defined results: null text is empty and yields one piece, its end token; very long texts are cut into
pieces; repeated rows are packed each for itself, ties of length by doc_id and piece; an empty table
yields no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import common

LENGTH = 4096
END = 1
GROUP_ROWS = 40_000
ROUNDS = 4
#: Words kept by one worker; the table starts anew when it is full.
CACHE = 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, sequence_id long, offset long, open boolean, bound long"


class Codec:
    """ids(text): little-endian uint32 ids of a whole text, without special tokens."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = [t.encode() for t in special]
        # xFF is in no UTF-8 text: it marks the end of a word, as </w> does
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                body = token.removesuffix("</w>")
                ranks[bytes(byte[c] for c in body) + b"\xff" * (body != token)] = i
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.latin = re.compile("[!-~¡-¬®-ɏ]+").fullmatch
        self.known: dict[bytes, bytes] = {}

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.latin(text):
            ids = [i for p in self.split(text.lower()) for i in self.fast(p.encode() + b"\xff")]
        else:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        if any(t in text for t in self.special):
            return np.array(self.slow.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        # before U+0300..U+036F a capital may compose otherwise than its small letter
        words = (text if b"\xcc" in text or b"\xcd" in text else text.lower()).split()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            out = []
            for w in words:
                x = known.get(w)
                if x is None:
                    x = self.word(w)
                    if len(w) <= 64:
                        known[w] = x
                out.append(x)
            return b"".join(out)


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces."""

    @common.lean
    def run(frames):
        import public_tokenizers

        c = codec(path or public_tokenizers.path("word_bpe_49k.json"))
        end = np.array([END], "<u4").tobytes()
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], common.encoded(f["text"]), strict=True):
                ids = c.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        c.known.clear()

    return common.texts(docs, "doc_id", "text").mapInPandas(run, _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = LENGTH) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int(n @ x) // capacity)
    big = np.cumsum(n[::-1])[::-1]  # pieces of at least x
    total = np.cumsum(n * x)
    for a in range(1, capacity // 2 + 1):  # more than capacity - a counts as whole, less than a as nothing
        whole = int(big[capacity - a + 1])
        best = max(best, whole - (-(int(total[capacity - a]) - int(total[a - 1])) // capacity))
    for k in range(1, 21):  # rounding down to multiples of capacity / k
        y = (k + 1) * x
        scaled = np.where(y % capacity == 0, x * k, y // capacity * capacity)
        best = max(best, -(-int(n @ scaled) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the free room of each bin; pieces are taken in the order given."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r tokens of room
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            b, r = len(free), capacity
            free.append(capacity)
        where[i], offset[i] = b, capacity - r
        free[b] = r - n
        if r > n:
            by_room[r - n].append(b)
            rooms |= 1 << (r - n)
    return where, offset, np.array(free, np.int64)


def _packer(stage: int, capacity: int):
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset, free = best_fit(f["length"].to_numpy(), capacity)
        bound = lower_bound(f["length"].to_numpy(), capacity)
        again = np.argsort(-free, kind="stable")[: 8 * (len(free) - bound) + 8]
        opened = np.zeros(len(free), bool)
        opened[again[free[again] > 0]] = True
        return f[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=(stage << 58) + (int(key[0]) << 24) + where, offset=offset, open=opened[where], bound=bound)

    return run


def pack(parts: DataFrame, capacity: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """parts with sequence_id and offset: see the module's text."""
    out, rows, kept, before = [], parts, None, 0
    for stage in range(ROUNDS):
        groups = max(1, -(-rows.count() // group_rows))
        # row numbers spread repeated rows too
        dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
        packed = common.stored(dealt.groupBy("g").applyInPandas(_packer(stage, capacity), _PACKED), f"pack-{stage}")
        if kept is not None and packed.agg(F.countDistinct("sequence_id")).first()[0] >= before:
            break  # nothing saved: the former bins stay
        out.append(packed.where("not open"))
        kept = packed.where("open")
        before = kept.agg(F.countDistinct("sequence_id")).first()[0]
        rows = kept.select(*parts.columns)
        if groups == 1 or not before:
            break
    done = kept
    for x in out:
        done = done.unionByName(x)
    return done.drop("open", "bound")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.stored(pieces(common.table(spark, sf_dir, "documents")), "pieces"))
