"""Personal data: overlapping candidates, boosted trees, calibrated thresholds.

* Base spans follow fixed patterns per kind (`base_spans`) and always stay.
* Generators with high recall propose overlapping candidates: other separators, missing `+`,
  bracketed `at` and `dot`, parts of longer digit runs (`candidates`).
* Boosted trees score each candidate by its format and context, whether it is a base span or not.
  There are no labels of personal data, so they are fitted on values of known kind: every different base
  span of the table, a made-up value in the context of each, and `MADE` made-up ones a kind without such
  a context. They are written in the base and the wider forms as positives; version, id and hash numbers
  and numbers of wrong check digit are put in the same contexts as negatives (`known`).
* All of them count. Those of a kind weigh at most as much as `SEEDS` base spans and `MADE` / 2
  made-up values, so that frequent kinds do not drown rare ones; cuts, trees and thresholds are exact sums over
  the whole table, by Spark.
* Thresholds: per kind, the lowest score above which at least `PRECISION` of the candidates of the
  held-out values (every fifth) are positives, by weight. Candidates above it that touch no
  base span and no better candidate are added.

Positions are code points, end exclusive. Defined cases: null text has no spans and stays null when
redacted; documents are judged one by one, so repeated rows and ids agree; a kind without any base
span is judged by the made-up values alone. Numbers are looked for inside runs of digits, blanks and
`().-` only, so long texts cost linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from idsignal.llm import boosting
from idsignal.llm.common import map_batches, packed, text_bytes
from idsignal.workspace import stage

KINDS = ["email", "ip", "card", "phone"]
#: What the base spans of a kind weigh at most, all together.
SEEDS = 400
MADE = 400
CONTEXT = 24
PRECISION = 0.98
BINS = 1000

LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ZONE = re.compile(rb"[0-9][0-9 ().\-]*")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
ANY_AT = re.compile(rb"@| ?[(\[]at[)\]] ?")
WRITTEN_DOT = re.compile(rb" ?[(\[]dot[)\]] ?")
ANY_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+")
WIDER = [
    (1, re.compile(rb"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])")),
    (1, re.compile(rb"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}")),
    (2, re.compile(rb"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    (2, re.compile(rb"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9])")),
    (2, re.compile(rb"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])")),
    (3, re.compile(rb"\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (3, re.compile(rb"\+[0-9](?:[ ().-]{0,2}[0-9]){8,14}(?![0-9])")),
]
NO_CUE = re.compile(rb"(?i)\b(?:v|no|nr)$|\b(?:version|release|build|rev|id|number|hash|sha|md5|crc|uuid|key|order|invoice|serial|sku|isbn|ref|ticket|section)\b")
CUE = re.compile(rb"(?i)mail|phone|tel|call|card|visa|ip|host|addr|contact|kontakt|fax|mobile")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def octets(number: bytes) -> bool:
    return all(len(p.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for p in number.replace(b" ", b"").split(b"."))


def _digits(value: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", value)


def emails(text: bytes) -> list[tuple[int, int]]:
    found, end, last_at = [], 0, -1
    at = text.find(b"@")
    while at >= 0:
        floor = max(end, last_at + 1)
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append((start, tail.end()))
            end = tail.end()
        last_at = at
        at = text.find(b"@", max(at + 1, end))
    return found


def zones(text: bytes) -> list[tuple[int, bytes]]:
    """(start, bytes) of the runs that numbers can lie in, with a `+` or `(` before them."""
    out = []
    for m in ZONE.finditer(text):
        if m.end() - m.start() < 7:
            continue
        start = m.start()
        while start and start > m.start() - 2 and text[start - 1] in b"+(":
            start -= 1
        out.append((start, text[start:m.end()]))
    return out


def base_spans(text: bytes, runs: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes."""
    spans = [(a, 0, b) for a, b in emails(text)]
    for at, run in runs:
        spans += [(at + m.start(), 1, at + m.end()) for m in IP.finditer(run) if octets(m[0])]
        for m in CARD.finditer(run):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((at + m.start(), 2, at + m.end()))
        spans += [(at + m.start(), 3, at + m.end()) for m in PHONE.finditer(run) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(spans)


def candidates(text: bytes, runs: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that may be personal data; they may overlap."""
    found = set()
    before = 0
    for m in ANY_AT.finditer(text):
        floor = max(before, m.start() - 64)
        start = floor + len(text[floor:m.start()].rstrip(LOCAL))
        tail = ANY_DOMAIN.match(text, m.end()) if start < m.start() else None
        if tail:
            found.add((start, 0, tail.end()))
        before = m.end()
    for at, run in runs:
        for kind, pattern in WIDER:
            found.update((at + m.start() + len(m[0]) - len(m[0].lstrip(b" .-")), kind, at + m.end()) for m in pattern.finditer(run))
    return sorted(found)


def features(text: bytes, start: int, kind: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    value, before, after = text[start:end], text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    digits = _digits(value)
    runs = [len(r) for r in re.findall(rb"[0-9]+", value)] or [0]
    plain = WRITTEN_DOT.sub(b".", ANY_AT.sub(b"@", value)) if kind == 0 else b""
    labels = plain.rpartition(b"@")[2].split(b".")
    return [
        kind, len(value), len(digits), len(value) - len(digits), len(runs), max(runs), min(runs),
        value.startswith(b"+"), b"(" in value, b" " in value, b"-" in value, b"." in value,
        luhn(digits) if digits else 0, octets(value) if kind == 1 else 0, len(set(digits)), int(digits[:1] in b"3456" and digits != b""),
        int(b"@" in value), len(labels), len(labels[-1]), int(labels[-1].isalpha()),
        int(before[-1:].isalnum()), int(after[:1].isalnum()), int(before[-1:] in b"+-.=:/#" and before != b""),
        int(after[:1] in b"-./@" and after != b""), len(_digits(before)), len(_digits(after)),
        int(bool(CUE.search(before))), int(bool(NO_CUE.search(before.rstrip(b" :=#.-")))), int(before[-1:].isspace()), int(after[:1].isspace()),
    ]


def points(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    out, last, count = {}, 0, 0
    for offset in sorted(set(offsets)):
        count += len(text[last:offset].decode("utf-8", "replace"))
        out[offset], last = count, offset
    return out


def scan(text: bytes | None) -> tuple[list, list]:
    """Base spans and candidates (start, kind, end, features), positions in bytes."""
    text = text or b""
    runs = zones(text)
    if not runs and b"@" not in text and b"at" not in text:
        return [], []
    base = base_spans(text, runs)
    return base, [(*c, features(text, *c)) for c in candidates(text, runs)]


def select(base: list[tuple], scored: list[tuple], limits: list[float]) -> list[tuple[int, int, int]]:
    """Base spans and the scored candidates (start, kind, end, score) to add, best first."""
    blocks, reach = [], 0  # base spans of different kinds may overlap: merged, so that neighbours decide
    for start, _, end in sorted(base):
        if blocks and start < reach:
            reach = max(reach, end)
            blocks[-1] = (blocks[-1][0], reach)
        else:
            blocks.append((start, end))
            reach = end
    taken = list(base)
    for start, kind, end, score in sorted(scored, key=lambda c: (-c[3], c[0], c[1], c[2])):
        if score < limits[kind]:
            continue
        at = bisect_left(blocks, (start, end))
        if (at == 0 or blocks[at - 1][1] <= start) and (at == len(blocks) or end <= blocks[at][0]):
            insort(blocks, (start, end))
            taken.append((start, kind, end))
    return sorted(taken)


SPAN = "struct<start:int,kind:int,end:int>"
CANDIDATE = "struct<start:int,kind:int,end:int,features:array<float>>"
SEED = "struct<kind:int,before:binary,value:binary,after:binary>"


def collect_candidates(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """(doc, base, candidates, seeds) per row, positions in code points; seeds are the base spans with their context."""
    rows = docs.select(packed(docs.select(*[f"`{c}`" for c in carry])).alias("doc"), text_bytes(text).alias("text"))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, base array<{SPAN}>, candidates array<{CANDIDATE}>, seeds array<{SEED}>"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, wider, near = [], [], []
        for value in batch.column("text").to_pylist():
            spans, proposed = scan(value)
            at = points(value or b"", [p for s in spans + proposed for p in (s[0], s[2])])
            base.append([{"start": at[a], "kind": k, "end": at[b]} for a, k, b in spans])
            wider.append([{"start": at[a], "kind": k, "end": at[b], "features": f} for a, k, b, f in proposed])
            near.append([{"kind": k, "before": value[max(0, a - CONTEXT):a], "value": value[a:b], "after": value[b:b + CONTEXT]}
                         for a, k, b in spans])
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        candidate = pa.struct([*span, pa.field("features", pa.list_(pa.float32()))])
        seed = pa.struct([("kind", pa.int32()), ("before", pa.binary()), ("value", pa.binary()), ("after", pa.binary())])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(base, pa.list_(span)), pa.array(wider, pa.list_(candidate)), pa.array(near, pa.list_(seed))],
            ["doc", "base", "candidates", "seeds"])

    return map_batches(rows, work, schema)


def seeds(found: DataFrame) -> DataFrame:
    """(kind, before, value, after, pick, other) of every different base span: a hash of it, and the kind to make up in its context."""
    rows = found.select(F.explode("seeds").alias("s")).select("s.*").distinct()
    pick = F.xxhash64(F.lit(5), "kind", "before", "value", "after")
    return rows.withColumn("pick", pick).withColumn("other", F.pmod(F.xxhash64(F.lit(7), "pick"), F.lit(len(KINDS))).cast("int"))


def _number(rng: np.random.Generator, size: int) -> bytes:
    return b"".join(b"%d" % d for d in rng.integers(0, 10, size))


def _card(rng: np.random.Generator, size: int, sound: bool = True) -> bytes:
    """`size` digits that start as cards do, with a right or a wrong check digit."""
    body = b"%d" % rng.integers(3, 7) + _number(rng, size - 2)
    check = next(d for d in range(10) if luhn(body + b"%d" % d))
    return body + b"%d" % (check if sound else (check + rng.integers(1, 10)) % 10)


def _grouped(rng: np.random.Generator, digits: bytes) -> bytes:
    mark = [b"", b" ", b"-", b"."][rng.integers(4)]
    return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4)) if mark else digits


def made_value(rng: np.random.Generator, kind: int) -> bytes:
    """A made-up value of a kind, in a base form."""
    if kind == 0:
        name = [b"anna", b"j.doe", b"info", b"name", b"kim_lee", b"sales", b"x12"][rng.integers(7)]
        return name + b"@" + [b"host", b"mail7.example", b"example", b"web-site", b"uni.edu"][rng.integers(5)] + [b".com", b".org", b".de", b".net", b".fr"][rng.integers(5)]
    if kind == 1:
        return b".".join(b"%d" % (rng.integers(0, 256) if rng.random() < 0.7 else rng.integers(0, 12)) for _ in range(4))
    if kind == 2:
        return _card(rng, 16)
    return b"+%d (%s) %s-%s" % (rng.integers(1, 100), _number(rng, 3), _number(rng, 3), _number(rng, 4))


def wider_form(rng: np.random.Generator, kind: int, value: bytes) -> bytes:
    """`value` in one of the forms people write it in, the base form among them."""
    if kind == 0:
        at = [b"@", b" [at] ", b" (at) ", b"[at]", b"(at)"][rng.integers(5)]
        dot = [b".", b" [dot] ", b" (dot) ", b"[dot]", b"(dot)"][rng.integers(5)]
        name, _, host = value.rpartition(b"@")
        return name + at + host.replace(b".", dot)
    if kind == 1:
        return value.replace(b".", [b".", b" . ", b". ", b" ."][rng.integers(4)])
    if kind == 2:
        digits = _digits(value)
        return _grouped(rng, digits if rng.random() < 0.5 else _card(rng, [13, 14, 15, 16, 19][rng.integers(5)]))
    digits = _digits(value)[-10:]
    area, middle, last = digits[:3], digits[3:6], digits[6:]
    prefix = [b"", b"", b"1 ", b"+1 ", b"+%d " % rng.integers(1, 100), b"1-"][rng.integers(6)]
    return prefix + [b"(%s) %s-%s", b"%s-%s-%s", b"%s.%s.%s", b"%s %s %s", b"(%s)%s-%s", b"(%s) %s %s"][rng.integers(6)] % (area, middle, last)


def other_number(rng: np.random.Generator, kind: int, value: bytes) -> tuple[bytes, bytes]:
    """(what stands before it, text) that yields candidates of a kind but is no personal data."""
    word = [b"version ", b"v", b"release ", b"build ", b"id ", b"id: ", b"no. ", b"hash ", b"sha ", b"order #", b"serial ", b"ref ", b"key=",
            b"invoice no. ", b"section "][rng.integers(15)]
    if kind == 0:
        name = [b"look", b"map", b"data", b"value", b"index"][rng.integers(5)]
        return b"", name + [b"(at)", b" (at) ", b" [at] ", b"@"][rng.integers(4)] + [b"3.2", b"1.21.3", b"i.j", b"x.0", b"node.1", b"a.b"][rng.integers(6)]
    if kind == 1:
        number = wider_form(rng, 1, value if rng.random() < 0.6 else made_value(rng, 1))
        if rng.random() < 0.6:
            return word, number
        return b"", [b".".join(b"%d" % n for n in rng.integers(256, 1000, 4)), number + b".%d" % rng.integers(0, 99), number + b"-%d" % rng.integers(0, 99)][rng.integers(3)]
    if kind == 2:
        size = [13, 14, 15, 16, 16, 17, 18, 19][rng.integers(8)]
        if rng.random() < 0.5:
            return word, _grouped(rng, _card(rng, size)) if rng.random() < 0.5 else _number(rng, size)
        if rng.random() < 0.3:
            return b"", _card(rng, size) + _number(rng, 8)
        return b"", _grouped(rng, _card(rng, size, False))
    area, middle, last = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    mark = [b"-", b".", b" "][rng.integers(3)]
    if rng.random() < 0.6:
        return word, mark.join((area, middle, last))
    return b"", [mark.join((_number(rng, 4), area, middle, last)), mark.join((area, middle, last, _number(rng, 3))), _number(rng, 9) + mark + last,
                 b"0x" + area + middle + mark + last, b"%s %s %s %s" % (_number(rng, 4), _number(rng, 5), middle, last)][rng.integers(5)]


CUES = [[b"", b"", b"mail ", b"write to ", b"contact: "], [b"", b"", b"host ", b"ip ", b"from "], [b"", b"", b"card ", b"visa: "],
        [b"", b"", b"call ", b"tel. ", b"phone: "]]


def known(rng: np.random.Generator, kind: int, before: bytes, value: bytes, after: bytes) -> list[tuple[bool, list[float]]]:
    """(label, features) of the candidates of a kind in texts written around a value.

    Candidates inside a number that is no personal data are negatives, as are those that hold less or
    more than a value that is; those of other kinds inside a value are left out.
    """
    out = []
    cue = CUES[kind][rng.integers(len(CUES[kind]))]
    lead = before if before[-1:].isspace() or not before else before + b" "
    tail = after if not after or after[:1] in b" \n,;!?)" else b" " + after
    word, other = other_number(rng, kind, value)
    written = [(True, lead + cue, wider_form(rng, kind, value)), (True, before, value), (False, lead + word, other)]
    for sound, head, middle in written:
        text = head + middle + tail
        start, end = len(head), len(head) + len(middle)
        for a, k, b in candidates(text, zones(text)):
            if k == kind and a < end and start < b:
                out.append((sound and (a, b) == (start, end), features(text, a, k, b)))
    return out


def examples(found: list[tuple[int, bytes, bytes, bytes]], made: int = MADE, seed: int = 3) -> list[tuple[int, bool, bool, list[float]]]:
    """(kind, held out, label, features) from given and made-up values; every fifth value is held out."""
    rng = np.random.default_rng(seed)
    around = [(b"", b"")] + [(b, a) for _, b, _, a in found]
    values = list(found)
    for kind in range(len(KINDS)):
        for i in range(made):
            before, after = around[rng.integers(len(around))] if i % 2 else (b"see the ", b" or so, and then")
            values.append((kind, before, made_value(rng, kind), after))
    return [(value[0], number % 5 == 0, *row) for number, value in enumerate(values) for row in known(rng, *value)]


EXAMPLE = "kind int, part int, held boolean, label boolean, features array<float>"
#: Parts of the labelled set: base spans, made-up values in their contexts, the other made-up values.
SPANS, IN_CONTEXT, MADE_UP = range(3)


def _example_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.float32())]
    columns = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "part", "held", "label", "features"])


def all_examples(values: DataFrame) -> DataFrame:
    """Candidates of known label from every row of `seeds`, and the made-up ones."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out = []
                for r in batch.slice(start, 1000).to_pylist():
                    rng = np.random.default_rng(r["pick"] & (1 << 64) - 1)
                    written = [(SPANS, r["kind"], r["value"]), (IN_CONTEXT, r["other"], made_value(rng, r["other"]))]
                    out += [(kind, part, r["pick"] % 5 == 0, label, [float(x) for x in row]) for part, kind, value in written
                            for label, row in known(rng, kind, r["before"], value, r["after"])]
                yield _example_batch(out)

    made = _example_batch([(k, MADE_UP, held, label, [float(x) for x in row]) for k, held, label, row in examples([])])
    return values.mapInArrow(run, EXAMPLE).unionByName(values.sparkSession.createDataFrame(pa.Table.from_batches([made])).to(StructType.fromDDL(EXAMPLE)))


def example_weights(values: DataFrame) -> Column:
    """What an example weighs, in `boosting.UNIT`, by its part and kind."""
    counts = values.groupBy("kind", "other").count().collect()
    weight = F.lit(boosting.UNIT)
    for part, most, column in ((SPANS, SEEDS, "kind"), (IN_CONTEXT, MADE // 2, "other")):
        for kind in range(len(KINDS)):
            n = sum(r["count"] for r in counts if r[column] == kind)
            if n > most:
                weight = F.when((F.col("part") == part) & (F.col("kind") == kind), F.lit(max(1, boosting.UNIT * most // n))).otherwise(weight)
    return weight.cast("long")


def cut_points(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Up to 32 exact quantiles of every feature of (features, weight), over all rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                table = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                weight = batch.column("weight").to_numpy(zero_copy_only=False)
                for f in range(width):
                    met, place = np.unique(table[:, f], return_inverse=True)
                    sums = np.zeros(len(met), np.int64)
                    np.add.at(sums, place, weight)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), f), pa.int32()), pa.array(met.astype(float)), pa.array(sums)], ["feature", "value", "weight"])

    counts = rows.select("features", "weight").mapInArrow(run, "feature int, value double, weight long").groupBy("feature", "value").agg(F.sum("weight").alias("weight"))
    found = counts.groupBy("feature").agg(F.percentile("value", [float(q) for q in np.linspace(0, 1, 33)[:-1]], F.col("weight")).alias("cuts")).collect()
    cuts = {r["feature"]: np.unique(r["cuts"]) for r in found}
    return [cuts.get(f, np.zeros(0)) for f in range(width)]


def in_bins(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(kind, held, label, bins, weight, n): equal examples are one row."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                table = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
                place = np.stack([np.searchsorted(edges, table[:, f]) for f, edges in enumerate(cuts)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "held", "label", "weight")], pa.array([r.tobytes() for r in place], pa.binary())],
                                                 ["kind", "held", "label", "weight", "bins"])

    return (rows.mapInArrow(run, "kind int, held boolean, label boolean, weight long, bins binary")
            .groupBy("kind", "held", "label", "bins").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))


def fit_model(found: DataFrame, name: str = "pii") -> tuple[dict, list[float]]:
    """Boosted trees and thresholds from all values of known kind."""
    values = stage(seeds(found), f"{name}-seeds")
    rows = stage(all_examples(values).withColumn("weight", example_weights(values)), f"{name}-examples")
    width = len(features(b"", 0, 0, 0))
    cuts = cut_points(rows.where("not held"), width)
    binned = stage(boosting.in_parts(in_bins(rows, cuts), rows.count()), f"{name}-binned")
    model, on_bins = boosting.grow(binned.where("not held"), cuts)
    return model, thresholds(held_scores(binned.where("held"), on_bins, width))


def held_scores(binned: DataFrame, on_bins: dict, width: int) -> np.ndarray:
    """Weights of the rows by kind, label and score in `BINS`."""

    def run(batches):
        for batch in batches:
            place = (predicted(on_bins, boosting.unpacked(batch.column("bins"), width)) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "label", "weight")], pa.array(place)], ["kind", "label", "weight", "place"])

    counts = binned.select("kind", "label", "weight", "bins").mapInArrow(run, "kind int, label boolean, weight long, place long")
    table = np.zeros((len(KINDS), 2, BINS + 1), np.int64)
    for kind, label, place, weight in counts.groupBy("kind", "label", "place").agg(F.sum("weight")).collect():
        table[kind, int(label), place] = weight
    return table


def score_candidates(found: DataFrame, model: dict) -> DataFrame:
    """`found` with a list of scores, one per candidate."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    kind = found.schema.simpleString()[len("struct<"):-1]

    def run(batches):
        for batch in batches:
            column = batch.column("candidates")
            flat = column.flatten().field("features")
            width = len(flat[0].as_py()) if len(flat) else 1
            rows = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
            scores = predicted(shared.value, rows)
            offsets = np.concatenate(([0], np.cumsum([len(v) for v in column])))
            yield batch.append_column("scores", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(scores)))

    return found.mapInArrow(run, f"{kind},scores:array<double>")


def predicted(model: dict, rows: np.ndarray) -> np.ndarray:
    return boosting.predict(model, rows) if len(rows) else np.zeros(0)


def thresholds(tables: np.ndarray, precision: float = PRECISION) -> list[float]:
    """Per kind: the lowest score with the wanted share of positives at or above it, at least 0.5."""
    limits = []
    for table in tables:
        above = table[:, ::-1].cumsum(1)[:, ::-1]
        right = np.flatnonzero((above[1] > 0) & (above[1] >= precision * above.sum(0)))
        limits.append(max(0.5, right[0] / BINS) if len(right) else 2.0)
    return limits


def fitted(docs: DataFrame, carry: list[str], text: str = "text", name: str = "pii") -> tuple[DataFrame, dict, list[float]]:
    """Scored candidates of every row, the model, the thresholds."""
    found = stage(collect_candidates(docs, carry, text), f"{name}-candidates")
    model, limits = fit_model(found, name)
    return score_candidates(found.drop("seeds"), model), model, limits


def find(docs: DataFrame, carry: list[str], text: str = "text", name: str = "pii") -> DataFrame:
    """(doc, base, spans): the base spans and all selected spans of every row, in code points."""
    scored, _, limits = fitted(docs, carry, text, name)
    kind = scored.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            spans = []
            for base, wider, scores in zip(*(batch.column(c).to_pylist() for c in ("base", "candidates", "scores"))):
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in select(
                    [(s["start"], s["kind"], s["end"]) for s in base],
                    [(c["start"], c["kind"], c["end"], p) for c, p in zip(wider, scores)], limits)])
            span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("base"), pa.array(spans, span)], ["doc", "base", "spans"])

    return scored.mapInArrow(run, f"doc {kind}, base array<{SPAN}>, spans array<{SPAN}>")


def listed(column: str) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cover(text: bytes, model: dict, limits: list[float]) -> bytes:
    """`text` with each run of touching spans replaced by its first span's kind in brackets."""
    base, wider = scan(text)
    if not base and not wider:
        return text
    scores = predicted(model, np.array([c[3] for c in wider], float).reshape(len(wider), -1))
    out, at = [], 0
    for start, kind, end in select(base, [(*c[:3], s) for c, s in zip(wider, scores)], limits):
        if start >= at:
            out += [text[at:start], b"[" + KINDS[kind].upper().encode() + b"]"]
        at = max(at, end)
    return b"".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", name: str = "pii") -> DataFrame:
    """`docs` with every selected span replaced by its kind; `length` follows the new text."""
    _, model, limits = fitted(docs, [], text, name)
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))
    rows = docs.select(packed(docs.drop(text)).alias("doc"), text_bytes(text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [None if t is None else cover(t, *shared.value) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(made, pa.binary())], ["doc", "text"])

    done = map_batches(rows, work, f"doc {rows.schema['doc'].dataType.simpleString()}, text binary")
    fresh = F.col("text").cast("string")
    columns = []
    for field in docs.schema:
        if field.name == text:
            columns.append(fresh.alias(text))
        elif field.name == length:
            columns.append(F.when(F.col("text").isNotNull(), F.char_length(fresh)).cast(field.dataType).alias(length))
        else:
            columns.append(F.col(f"doc.`{field.name}`").alias(field.name))
    return done.select(*columns)
