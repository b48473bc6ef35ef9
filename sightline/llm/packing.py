"""Best-fit packing of tokenised documents into fixed sequences, improved by local search.

Documents become ids plus one end id; only documents longer than a sequence are cut, so that all
but their first piece fill a sequence.  Pieces are dealt evenly to blocks of about ``BLOCK``
pieces, and each block is packed by best fit in falling order of length.  A local search then
takes the underfull bins in turn, the emptiest first, and moves one or two of their pieces, or
exchanges them one for one, or two for one, with other underfull bins, whenever that raises the
sum of squared fills; it sweeps until no bin can do so.  It ends early when no smaller number of
bins is possible.  The pieces of bins that stay underfull are dealt to blocks again, packed and
searched together, in ``ROUNDS`` rounds at most.

Defined cases: null or empty text is one piece that holds the end id alone; very long texts are
cut, never dropped; repeated rows are packed each; a null id is passed through; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import kernels as K
from sightline.plans.store import materialize

BLOCK, ROUNDS = 4096, 4
#: The word pattern of the byte-level vocabulary; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of a byte-level BPE vocabulary in the JSON form of the tokenizers library.

    Texts of Latin letters go through a faster encoder of the same merges; for these, both
    libraries' character classes agree.  All others go through the tokenizers library itself.
    """

    latin = re.compile("[\x00-ɏ‐-‧]*").fullmatch

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path, self._full = path, None
        told = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        plain = {k: v for k, v in told["model"]["vocab"].items() if k not in special}
        byte = {}  # the printable stand-ins of bytes in such files
        odd = 0
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                byte[chr(b)] = b
            else:
                byte[chr(256 + odd)] = b
                odd += 1
        ranks = {bytes(byte[c] for c in k): v for k, v in plain.items()}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @property
    def full(self):
        """The library's own tokenizer, loaded when a text first needs it."""
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.path)
            self._full.no_padding()
            self._full.no_truncation()
        return self._full

    def __call__(self, text: str) -> np.ndarray:
        if self.latin(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_loaded: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def best_fit(lengths: np.ndarray, room: int) -> np.ndarray:
    """The bin of each piece, by best fit in falling order of length."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]
    mask, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask &= ~(1 << left)
        else:
            left, b = room, made
            made += 1
        bins[i] = b
        free[left - n].append(b)
        mask |= 1 << left - n
    return bins


def _sets(pieces: list[int], lengths: np.ndarray) -> list[tuple[int, int, tuple[int, ...]]]:
    """(size, count, pieces) of no, one and two pieces of a bin, one set for each size and count."""
    by_length = {}
    for i in pieces:
        by_length.setdefault(int(lengths[i]), []).append(i)
    found = {(0, 0): ()} | {(n, 1): (own[0],) for n, own in by_length.items()}
    for (n, own), (m, more) in itertools.combinations_with_replacement(by_length.items(), 2):
        if own is not more or len(own) > 1:
            found.setdefault((n + m, 2), (own[0], more[-1]))
    return [(size, count, held) for (size, count), held in found.items()]


def improve(lengths: np.ndarray, bins: np.ndarray, room: int) -> np.ndarray:
    """Local search by moves and exchanges between underfull bins; see the module's text."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // room)
    used = int((fill > 0).sum())
    if used <= least:
        return bins
    held: list[list[int]] = [[] for _ in fill]
    for i, b in enumerate(bins.tolist()):
        held[b].append(i)
    open_ = set(np.flatnonzero((fill > 0) & (fill < room)).tolist())
    sets = {b: _sets(held[b], lengths) for b in open_}
    arrays = {b: np.array([x[:2] for x in own], dtype=np.int64) for b, own in sets.items()}
    changed, failed, log = dict.fromkeys(open_, 0), dict.fromkeys(open_, -1), []

    def best_of(donor: int, others: list[int]):
        """The exchange that raises the sum of squares most: (worth, mine, theirs, other)."""
        size, many = np.concatenate([arrays[b] for b in others]).T
        sizes = [len(arrays[b]) for b in others]
        at, first = np.repeat(others, sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = np.arange(len(at))
        best = None
        for k in (1, 2):  # against two pieces at most, or one
            fit = rows[many + k <= 3]
            own_size, own_fill = size[fit], fill[at[fit]]
            for n, count, mine in sets[donor]:
                if count == k:
                    gain = n - own_size
                    worth = np.where((gain > 0) & (own_fill + gain <= room), gain * (own_fill - fill[donor] + gain), 0)
                    top = int(np.argmax(worth))
                    if worth[top] > 0 and (best is None or worth[top] > best[0]):
                        row = int(fit[top])
                        best = (int(worth[top]), mine, sets[int(at[row])][row - int(first[row])][2], int(at[row]))
        return best

    moved = True
    while moved and used > least:
        moved = False
        for donor in sorted(open_, key=lambda b: (int(fill[b]), b)):
            while donor in open_ and used > least:
                # a donor that failed can only succeed with bins that changed since
                again = failed[donor] >= changed[donor]
                others = sorted((set(itertools.chain(*log[failed[donor] :])) & open_ if again else open_) - {donor})
                best = best_of(donor, others) if others else None
                if best is None:
                    failed[donor] = len(log)
                    break
                moved = True
                _, mine, theirs, other = best
                for group, src, dst in ((mine, donor, other), (theirs, other, donor)):
                    for i in group:
                        held[src].remove(i)
                        held[dst].append(i)
                        bins[i] = dst
                        fill[src] -= lengths[i]
                        fill[dst] += lengths[i]
                log.append((donor, other))
                for b in (donor, other):
                    if 0 < fill[b] < room:
                        sets[b] = _sets(held[b], lengths)
                        arrays[b] = np.array([x[:2] for x in sets[b]], dtype=np.int64)
                        changed[b] = len(log)
                    else:
                        open_.discard(b)
                used -= int(fill[donor] == 0)
    return bins


def _pieces(tokenizer: str, room: int, end_id: int, with_ids: bool):
    schema = K.columns("doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))

    def run(batches):
        encode = encoder(tokenizer)
        end, squeeze = np.array([end_id], dtype="<u4"), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows, keep = [], []
                part = batch.slice(at, 512)
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = np.concatenate([encode(text or "").astype("<u4"), end])
                    raw, cut = ids.tobytes(), len(ids) % room or room
                    edges = [0, *range(min(cut, len(ids)), len(ids) + 1, room)]
                    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        own = raw[4 * a : 4 * b]
                        rows.append((doc, n, a, b - a, zlib.crc32(own)))
                        if with_ids:
                            keep.append(squeeze(own))
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema.types, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(keep, pa.binary())] if with_ids else []), schema=schema)

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")


def _opened(batches):
    """The last column as it was before it was squeezed."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(open_, part.column(part.num_columns - 1).to_pylist()), pa.binary())], schema=part.schema)


def _pack(room: int, base: int = 0):
    """Packs a block's pieces anew; those of later rounds come in bins, which stay if that needs more."""

    def run(key, rows):
        lengths = rows["length"].to_numpy()
        short = np.flatnonzero(lengths < room)
        bins = np.arange(len(lengths)) + len(lengths)
        if len(short):
            bins[short] = improve(lengths[short], best_fit(lengths[short], room), room)
            if base:
                had = np.unique(rows["sequence_id"].to_numpy()[short], return_inverse=True)[1]
                if had.max() < len(np.unique(bins[short])):
                    bins[short] = had
        order = np.lexsort((rows["piece"].to_numpy(), bins))
        ends = np.cumsum(lengths[order])
        new = np.ones(len(order), dtype=bool)
        new[1:] = bins[order][1:] != bins[order][:-1]
        before = ends - lengths[order]
        offsets = before - before[new][np.cumsum(new) - 1]
        fills = np.add.reduceat(lengths[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        out = rows.select([c for c in rows.column_names if c not in ("block", "sequence_id", "offset", "underfull")]).take(pa.array(order))
        out = out.append_column("sequence_id", pa.array(bins[order] + (key[0].as_py() + base << 24)))
        return out.append_column("offset", pa.array(offsets)).append_column("underfull", pa.array(fills < room))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece.

    ``ids`` holds little-endian unsigned 32-bit ids.  They don't travel through the rounds of
    packing: they are kept and joined to the result compressed.
    """
    run, schema = _pieces(tokenizer, room, end_id, with_ids)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = text.mapInArrow(run, schema)
    if with_ids:
        pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
        packed = _packed(pieces.drop("ids"), room, block)
        joined = packed.join(pieces.select("uid", "ids"), "uid").drop("uid")
        return joined.mapInArrow(_opened, joined.schema)
    return _packed(materialize(pieces, "pieces"), room, block)


def _packed(pieces: DataFrame, room: int, block: int) -> DataFrame:
    """The pieces with sequence_id and offset; each round is written before the next."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, underfull boolean"
    blocks = max(1, -(-pieces.count() // block))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    packed = materialize(dealt.groupBy("block").applyInArrow(_pack(room), schema), "packed")
    out, base = None, 0
    for n in range(ROUNDS):
        if blocks == 1:
            break
        left = packed.filter("underfull")
        count, tokens, bins = left.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.countDistinct("sequence_id")).first()
        if bins <= -(-tokens // room):
            break
        full = packed.filter("not underfull")
        out, base, blocks = full if out is None else out.union(full), base + blocks, -(-count // block)
        dealt = left.withColumn("block", F.pmod(F.xxhash64("sequence_id", F.lit(n)), F.lit(blocks)))
        packed = materialize(dealt.groupBy("block").applyInArrow(_pack(room, base), schema), "packed")
    return (packed if out is None else out.union(packed)).drop("underfull")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
