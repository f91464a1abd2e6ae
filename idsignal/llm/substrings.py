"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is `WINDOW` consecutive words of one text. Its minimiser is the smallest, by hash, of its
`MER`-word runs; consecutive windows that share one travel together, as one packed string of words,
to the minimiser's bucket. Equal windows have equal minimisers, so a bucket sees every copy of its
windows. There the words get dense numbers, windows are sorted by a rolling hash, equal neighbours
are compared word by word, and every copy but the first by (id, text hash, start) is marked.

* Common runs: a count sketch over all texts tells which hash cells hold far more runs than usual;
  their runs come last in the order, so a line or phrase in a third of all documents becomes
  nobody's minimiser as long as a window holds anything rarer.
* Common passages: a slice of a task sends equal strings once, with the first place; the other
  copies are removed whole on the spot. A bucket does the same before it looks at windows.
* Strings travel compressed, one block per slice and bucket; the number of buckets follows the
  number of words.

Defined cases: null text has no words; a null id comes after all others; different texts with equal
ids are ordered by their hash; a row that equals another in id and text is the same document, so
both get the verdict that one would; texts under `WINDOW` words lose nothing. Ids are integers.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from idsignal.llm.common import packed, slices, text_bytes

WINDOW = 20
MER = 4
CELLS = 1 << 16
COMMON = 8
BUCKET_WORDS = 1 << 19
PIECE = 1 << 18
LEVEL = 6
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


def scramble(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return values ^ (values >> np.uint64(29))


def mer_hashes(words: list[bytes], mer: int = MER) -> np.ndarray:
    """A 64-bit hash of every run of `mer` words."""
    if len(words) < mer:
        return np.zeros(0, np.uint64)
    each = scramble(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    n = len(words) - mer + 1
    out = each[:n]
    for i in range(1, mer):
        out = scramble(out) + each[i:i + n]
    return scramble(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def runs_of_windows(words: list[bytes], common: np.ndarray):
    """(first window, windows, minimiser) of each super-k-mer of a text."""
    width = WINDOW - MER + 1
    hashes = mer_hashes(words)
    for at in range(0, len(words) - WINDOW + 1, PIECE):
        some = hashes[at:at + PIECE + width - 1]
        late = common[(some & np.uint64(len(common) - 1)).astype(np.int64)].astype(np.uint64)
        key = (late << np.uint64(63)) | ((some >> np.uint64(21)) << np.uint64(20)) | np.arange(len(some), dtype=np.uint64)
        least = sliding_min(key, width)
        cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        sizes = np.diff(np.append(cut, len(least)))
        yield from zip((cut + at).tolist(), sizes.tolist(), (least[cut] >> np.uint64(20)).tolist())


def sketch(rows: DataFrame, cells: int = CELLS) -> tuple[np.ndarray, int]:
    """Whether each hash cell holds common runs, and the number of runs in all texts."""

    def run(batches):
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = np.concatenate([mer_hashes((t or b"").split()) for t in part.column("text").to_pylist()])
                counts += np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], ["cell", "n"])

    sums = rows.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).persist()
    total = sums.agg(F.sum("n")).first()[0] or 0
    limit = max(1000, math.ceil(COMMON * total / cells))
    common = np.zeros(cells, bool)  # at most cells / COMMON are set
    common[[r["cell"] for r in sums.where(F.col("n") >= limit).select("cell").collect()]] = True
    sums.unpersist()
    return common, int(total)


Place = tuple  # (id is null, id, text hash, start)


def _pack(strings: list[bytes], places: list[Place], sizes: list[int]) -> bytes:
    n = len(strings)
    numbers = np.array([[p[0], p[1], p[2], p[3], s] for p, s in zip(places, sizes)], np.int64).T.tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(struct.pack("<q", n) + numbers + b" ".join(strings))


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", data)[0]
    return np.frombuffer(data, np.int64, 5 * n, 8).reshape(5, n), data[8 + 40 * n:]


RANGES = "bucket long, blob binary, unknown boolean, id long, hash long, start long, windows long"


def _ranges(found: list[tuple]) -> pa.RecordBatch:
    """Removed windows (null, id, hash, start, windows); neighbours of one text are joined."""
    found.sort()
    out = []
    for unknown, key, text, start, n in found:
        last = out[-1] if out else None
        if last and last[:3] == [unknown, key, text] and last[3] + last[4] >= start:
            last[4] = max(last[4], start + n - last[3])
        else:
            out.append([unknown, key, text, start, n])
    columns = list(zip(*out))
    none = pa.nulls(len(out), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([hash_of(r) for r in out], pa.int64()), pa.nulls(len(out), pa.binary()), pa.array(map(bool, columns[0]), pa.bool_()),
         *[pa.array(c, pa.int64()) for c in columns[1:]]], [c.split()[0] for c in RANGES.split(", ")]) if out else \
        pa.RecordBatch.from_arrays([none, pa.nulls(0, pa.binary()), pa.nulls(0, pa.bool_()), none, none, none, none],
                                   [c.split()[0] for c in RANGES.split(", ")])


def hash_of(row: list) -> int:
    """Spreads finished rows over the buckets they pass through."""
    return (row[2] ^ row[3]) & 0x7FFFFFFF


def cut_texts(rows: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """Blocks of super-k-mers per bucket, and the windows already known to be copies."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                first: dict[bytes, tuple[Place, int, int]] = {}
                gone: list[tuple] = []
                for text, key, mark in zip(*(part.column(c).to_pylist() for c in ("text", "id", "hash"))):
                    words = (text or b"").split()
                    for start, n, minimiser in runs_of_windows(words, shared.value):
                        string = b" ".join(words[start:start + n + WINDOW - 1])
                        place = (key is None, key or 0, mark, start)
                        held = first.get(string)
                        if held is None or place < held[0]:
                            first[string] = (place, n, minimiser)
                            if held is None:
                                continue
                            place = held[0]
                        if place != first[string][0]:
                            gone.append((*place, n))
                blocks: dict[int, list] = {}
                for string, (place, n, minimiser) in first.items():
                    blocks.setdefault(minimiser % buckets, []).append((string, place, n))
                keys = list(blocks)
                blobs = [_pack(*map(list, zip(*blocks[k]))) for k in keys]
                none = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(len(keys), pa.bool_()),
                                                  none, none, none, none], [c.split()[0] for c in RANGES.split(", ")])
                if gone:
                    yield _ranges(gone)

    return rows.mapInArrow(run, RANGES)


def window_hashes(ids: np.ndarray) -> np.ndarray:
    """A rolling hash of every `WINDOW` consecutive numbers (20 = 16 + 4)."""
    h = scramble(ids.astype(np.uint64) + np.uint64(1))
    powers, parts, span = {1: h}, h, 1
    while span < 16:
        parts = parts[:-span] * np.uint64(pow(BASE, span, 1 << 64)) + parts[span:]
        span *= 2
        powers[span] = parts
    out, at = powers[16], 16
    rest = WINDOW - 16
    while rest:
        step = 1 << (rest.bit_length() - 1)
        tail = powers[step][at:]
        n = min(len(out), len(tail))
        out = out[:n] * np.uint64(pow(BASE, step, 1 << 64)) + tail[:n]
        at, rest = at + step, rest - step
    return out


def repeated_windows(strings: list[bytes], places: list[Place], sizes: list[int]) -> list[tuple]:
    """Windows of different strings that are not the first of their kind: (null, id, hash, start, 1...)."""
    if not strings:
        return []
    flat = pc.split_pattern(pa.array([b" ".join(strings)], pa.large_binary()), b" ").flatten()
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    n = np.array(sizes, np.int64)
    begin = np.concatenate(([0], np.cumsum(n + WINDOW - 1)[:-1]))
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + inside
    hashes = window_hashes(ids)[at]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    involved = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    rows = ids[at[involved][:, None] + np.arange(WINDOW)]
    # equal hashes lie together; numbering starts anew wherever the words differ from the row before
    fresh = np.concatenate(([True], (hashes[involved][1:] != hashes[involved][:-1]) | (rows[1:] != rows[:-1]).any(1)))
    clash = np.concatenate(([False], (hashes[involved][1:] == hashes[involved][:-1]) & (rows[1:] != rows[:-1]).any(1)))
    if clash.any():  # different words under one hash: number the windows by their words instead
        kind = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    else:
        kind = np.cumsum(fresh)
    rank = {p: i for i, p in enumerate(sorted({p[:3] for p in places}))}
    text = np.array([rank[p[:3]] for p in places])[owner[involved]]
    start = np.array([p[3] for p in places])[owner[involved]] + inside[involved]
    sort = np.lexsort((start, text, kind))
    later = np.concatenate(([False], kind[sort][1:] == kind[sort][:-1]))
    marked = sort[later]
    who = owner[involved][marked].tolist()
    return [(*places[w][:3], s, 1) for w, s in zip(who, start[marked].tolist())]


def find_ranges(blocks: DataFrame, buckets: int) -> DataFrame:
    """(unknown, id, hash, start, windows): all windows to remove, bucket by bucket."""
    parts = max(1, -(-buckets // 4))
    dealt = blocks.repartition(parts, "bucket").sortWithinPartitions(F.col("blob").isNull(), "bucket")

    def settle(blobs: list[bytes]):
        first: dict[bytes, tuple[Place, int]] = {}
        gone: list[tuple] = []
        for blob in blobs:
            numbers, text = _unpack(blob)
            words = text.split(b" ")
            at = 0
            for unknown, key, mark, start, n in numbers.T.tolist():
                string = b" ".join(words[at:at + n + WINDOW - 1])
                at += n + WINDOW - 1
                place = (bool(unknown), key, mark, start)
                held = first.get(string)
                if held is None or place < held[0]:
                    first[string] = (place, n)
                    if held is None:
                        continue
                    place = held[0]
                if place != first[string][0]:
                    gone.append((*place, n))
        gone += repeated_windows(list(first), [v[0] for v in first.values()], [v[1] for v in first.values()])
        return _ranges(gone) if gone else None

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                blob = batch.column("blob")[row].as_py()
                if blob is None:  # finished rows come last
                    break
                key = batch.column("bucket")[row].as_py()
                if key != bucket and held:
                    if (made := settle(held)) is not None:
                        yield made
                    held = []
                bucket = key
                held.append(blob)
            done = batch.filter(pc.is_null(batch.column("blob")))
            if done.num_rows:
                yield done
        if held and (made := settle(held)) is not None:
            yield made

    return dealt.mapInArrow(run, RANGES).select("unknown", "id", "hash", "start", "windows")


def remove(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    """`words` without those covered by the ranges (first window, windows)."""
    kept, at = [], 0
    for start, n in sorted(ranges):
        kept += words[at:start]
        at = max(at, start + n + WINDOW - 1)
    return kept + words[at:]


def dedup(docs: DataFrame, carry: list[str], text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc, n_words, n_removed, kept_text) per row; kept words are joined by one space."""
    body = text_bytes(text)
    rows = docs.select(packed(docs.select(*[f"`{c}`" for c in carry])).alias("doc"), F.col(f"`{id_column}`").cast("long").alias("id"),
                       F.xxhash64(F.lit(3), body).alias("hash"), body.alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    common, runs = sketch(rows)
    buckets = max(16, -(-runs // BUCKET_WORDS))
    found = find_ranges(cut_texts(rows.select("id", "hash", "text"), common, buckets), buckets)
    both = (rows.select("doc", "id", "hash", "text", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("windows"), F.lit(True).alias("is_doc"))
            .unionAll(found.select(F.lit(None).cast(kind).alias("doc"), F.when(~F.col("unknown"), F.col("id")).alias("id"), "hash",
                                   F.lit(None).cast("binary").alias("text"), "start", "windows", F.lit(False).alias("is_doc"))))
    met = both.repartition("id", "hash").sortWithinPartitions("id", "hash", "is_doc")

    def run(batches):
        key, ranges = None, []
        for batch in batches:
            owner, counts, removed, texts = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("id", "hash", "text", "start", "windows", "is_doc")]
            for i, (doc, mark, value, start, n, is_doc) in enumerate(zip(*columns)):
                if key != (doc, mark):
                    key, ranges = (doc, mark), []
                if not is_doc:
                    ranges.append((start, n))
                    continue
                words = (value or b"").split()
                kept = remove(words, ranges) if ranges else words
                owner.append(i)
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept))
            if owner:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(owner, pa.int32())), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(texts, pa.binary())], ["doc", "n_words", "n_removed", "kept"])

    made = met.mapInArrow(run, f"doc {kind}, n_words long, n_removed long, kept binary")
    return made.select("doc", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
