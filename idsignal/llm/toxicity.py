"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

* Folding (`fold_text`) keeps one character per character: lower case, look-alike letters of other
  alphabets and digits that stand for letters become one letter of their class (i, l, 1 and | are
  one class), `@` and `$` inside words too; all that is no letter then becomes a space.
* Lexicon: stems (beginnings of words, `STEM` characters and more) and whole words, which end in a
  space, counted in all labelled documents. Those in at least `SUPPORT` toxic ones whose log odds of
  toxic against clean are high (`MIN_WEIGHT`) and sure (`MIN_Z`, the root of the likelihood ratio, which
  also judges words that no clean document has) weigh their log odds, less those a shorter one stands
  for. No bar depends on the size of the table. The automaton is in every worker's memory: beyond
  `LEXICON` sure words or exceptions the operator raises an error, it drops none.
* Exceptions: a neighbour with a lexicon word, in whose company the word is no sign of toxicity in
  the labelled documents, takes its match away.
* Score: matched weight and matched weight per word, through a logistic curve fitted on at most
  `FIT_ROWS` labelled documents chosen by hash.

Defined cases: null or empty text matches nothing and gets the score of a clean text; rows are scored
one by one, so repeated rows agree; a document with several labels counts as toxic if one is; null
labels are left out; without toxic or without clean labelled rows every score is 0. Matches begin
where a word begins, the best one counts per word, in texts of any length.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from idsignal.llm.common import packed, slices, text_bytes
from idsignal.workspace import stage

SUPPORT = 5
LEXICON = 1_000_000
MIN_WEIGHT = 1.5
MIN_Z = 4.0
STEM = (4, 10)
FLUSH = 300_000
FIT_ROWS = 50_000
#: Letters of other alphabets, digits and signs that look like a Latin letter.
LOOK_ALIKES = {
    "а": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ё": "e", "ɡ": "g",
    "һ": "h", "н": "h", "η": "n", "і": "i", "ι": "i", "ї": "i", "ı": "i", "ӏ": "i", "ј": "j", "к": "k", "κ": "k",
    "м": "m", "μ": "m", "п": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "т": "t", "τ": "t", "υ": "u", "ц": "u", "ν": "v", "ѵ": "v", "ω": "w", "ԝ": "w", "х": "x", "χ": "x", "у": "y",
    "γ": "y", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "|": "i", "l": "i",
}
SIGNS = re.compile(r"(?<=\w)[@$|](?=\w)")
SIGN_LETTERS = {"@": "a", "$": "s", "|": "i"}


class Folding(dict):
    """Code point to folded code point, worked out once per character."""

    def __missing__(self, point: int) -> int:
        char = chr(point)
        low = char.lower()
        low = low if len(low) == 1 else char
        low = LOOK_ALIKES.get(low, low)
        if not low.isascii():
            plain = unicodedata.normalize("NFKD", low)[:1].lower()  # letters without their marks, full-width forms
            low = LOOK_ALIKES.get(plain, plain) or " "
        self[point] = ord(low) if low.isalpha() else 32
        return self[point]


@lru_cache(maxsize=1)
def _folding() -> Folding:
    return Folding()


def fold_text(text: bytes | None) -> str:
    plain = (text or b"").decode("utf-8", "replace")
    if "@" in plain or "$" in plain or "|" in plain:
        plain = SIGNS.sub(lambda m: SIGN_LETTERS[m[0]], plain)
    return plain.translate(_folding())


def labelled_texts(docs: DataFrame, labels: DataFrame, learn: Column, text: str, id_column: str, name: str) -> DataFrame:
    """(toxic, pick, text) of the labelled rows to learn from, written to the shared folder; `pick` is a hash of id and text."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic")))
    rows = docs.where(learn).select(F.col(f"`{id_column}`").alias("id"), text_bytes(text).alias("text"))
    # always a merge join: a plan that changes with the size of the labels makes costs hard to foresee
    return stage(rows.join(marks.hint("merge"), rows["id"] == marks["labelled"]).select(
        (F.col("toxic") != 0).alias("toxic"), F.xxhash64(F.lit(9), "id", "text").alias("pick"), "text"), f"{name}-labelled")


def stems(word: str) -> list[str]:
    """The beginnings of a word and, with a space after it, the word."""
    return [word[:n] for n in range(STEM[0], min(len(word), STEM[1]) + 1)] + [word + " "]


def count_tokens(rows: DataFrame, tokens) -> DataFrame:
    """(token, t, c): the toxic and the clean texts that hold a token, summed per task before the shuffle."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            columns = [list(counts), [v[1] for v in counts.values()], [v[0] for v in counts.values()]]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(x, pa.int64()) for x in columns[1:]]], ["token", "t", "c"])

        for part in (part for batch in batches for part in slices(batch, "text")):
            for toxic, text in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist()):
                for token in tokens(fold_text(text).split()):
                    counts.setdefault(token, [0, 0])[toxic] += 1
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return (rows.mapInArrow(run, "token string, t long, c long").groupBy("token")
            .agg(F.sum("t").alias("t"), F.sum("c").alias("c")))


def odds(counts: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """`counts` with weight, the log odds of toxic against clean, and z, how sure it is.

    z is the signed root of the likelihood ratio of the observed split against that of all labelled rows.
    """
    toxic, clean = totals
    t, c, n = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (n * F.lit(share)))).otherwise(0.0)
    ratio = 2 * (part(t, toxic / (toxic + clean)) + part(c, clean / (toxic + clean)))
    return counts.withColumn("weight", weight).withColumn("z", F.signum("weight") * F.sqrt(F.greatest(ratio, F.lit(0.0))))


def gathered(found: DataFrame, limit: int) -> list:
    """The rows of `found`; an error, not a cut, if they are more than every worker may hold."""
    rows = found.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} words or phrases are sure signs: raise MIN_Z or split the labels by language")
    return rows


def learn_lexicon(rows: DataFrame, totals: tuple[int, int]) -> dict[str, float]:
    """Folded stem or word to weight."""
    counts = count_tokens(rows, lambda words: {s for w in set(words) if len(w) > 2 for s in stems(w)})
    found = odds(counts.where(F.col("t") >= SUPPORT), totals)
    sure = gathered(found.where((F.col("weight") >= MIN_WEIGHT) & (F.col("z") >= MIN_Z)).select("token", "weight"), LEXICON)
    lexicon: dict[str, float] = {}
    for r in sorted(sure, key=lambda r: (len(r["token"]), r["token"])):
        shorter = max((lexicon.get(r["token"][:n], 0.0) for n in range(STEM[0], len(r["token"]))), default=0.0)
        if r["weight"] > 1.2 * shorter:
            lexicon[r["token"]] = r["weight"]
    return lexicon


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float], totals: tuple[int, int]) -> list[str]:
    """Two-word phrases with a lexicon word that are no sign of toxicity, a space after them."""

    def phrases(words: list[str]) -> set[str]:
        hits = [i for i, w in enumerate(words) if any(s in lexicon for s in stems(w))]
        return {f"{words[j]} {words[j + 1]} " for i in hits for j in (i - 1, i) if j >= 0 and j + 1 < len(words)}

    found = odds(count_tokens(rows, phrases), totals).where((F.col("c") >= SUPPORT) & (F.col("weight") <= 0))
    return sorted(r["token"] for r in gathered(found.select("token"), LEXICON))


class Matcher:
    """Lexicon entries at the beginnings of words of a folded text, less words inside an exception phrase."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        self.automaton = ahocorasick.Automaton()
        for word, weight in lexicon.items():
            self.automaton.add_word(word, (len(word), float(weight)))
        for phrase in exceptions:
            second = phrase.index(" ") + 1
            self.automaton.add_word(phrase, (len(phrase), second))
        if lexicon:
            self.automaton.make_automaton()
        self.empty = not lexicon

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the best match of each word; `text` has one space between words and at its end."""
        if self.empty or not text:
            return []
        words: dict[int, tuple[int, int, float]] = {}
        shielded: set[int] = set()
        for end, (size, weight) in self.automaton.iter(text):
            start = end - size + 1
            if start and text[start - 1] != " ":
                continue
            if isinstance(weight, int):  # a phrase: where its second word begins
                shielded.update((start, start + weight))
            elif start not in words or words[start][2] < weight:
                words[start] = (start, end + 1, weight)
        return [match for start, match in words.items() if start not in shielded]


def measure(matcher: Matcher, text: bytes | None) -> tuple[int, int, float]:
    """Words, different matches, and their weight, of a text: saying one thing often proves no more."""
    words = fold_text(text).split()
    plain = " ".join([*words, ""])
    found = {plain[a:b]: w for a, b, w in matcher.hits(plain)}
    return len(words), len(found), sum(found.values())


def signals(words: np.ndarray, hits: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What the curve sees: matched weight, matched weight per word, whether there is a match."""
    return np.column_stack([np.log1p(weight), np.log1p(100 * weight / (words + 20.0)), hits > 0]).astype(float)


def fit_curve(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; the last number is the intercept."""
    x = np.column_stack([rows, np.ones(len(rows))])
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip((x * beta).sum(1), -30, 30)))
        slope = (x * (labels - p)[:, None]).sum(0) - 1e-2 * beta
        curve = np.einsum("ni,n,nj->ij", x, p * (1 - p), x) + 1e-2 * np.eye(len(beta))
        beta = beta + _solve(curve, slope)
    return beta


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gauss elimination of a small symmetric system."""
    a, b = a.copy(), b.copy()
    n = len(b)
    for i in range(n):
        for j in range(i + 1, n):
            f = a[j, i] / a[i, i]
            a[j] -= f * a[i]
            b[j] -= f * b[i]
    out = np.zeros(n)
    for i in range(n - 1, -1, -1):
        out[i] = (b[i] - (a[i, i + 1:] * out[i + 1:]).sum()) / a[i, i]
    return out


def measured(rows: DataFrame, lexicon: dict[str, float], exceptions: list[str], carry: str, kind: str) -> DataFrame:
    """`carry` with words, hits and weight of each text."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, exceptions))

    def run(batches):
        matcher = Matcher(*shared.value)
        for part in (part for batch in batches for part in slices(batch, "text")):
            found = [measure(matcher, t) for t in part.column("text").to_pylist()]
            words, hits, weight = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(carry), pa.array(words, pa.int64()), pa.array(hits, pa.int64()),
                                              pa.array(weight, pa.float64())], [carry, "words", "hits", "weight"])

    return rows.select(carry, "text").mapInArrow(run, f"{carry} {kind}, words long, hits long, weight double")


def score(docs: DataFrame, labels: DataFrame, learn: Column, carry: list[str], text: str = "text", id_column: str = "doc_id",
          name: str = "toxicity") -> DataFrame:
    """(doc, score, words, hits, weight) per row, learned from the labelled rows that `learn` names."""
    known = labelled_texts(docs, labels, learn, text, id_column, name)
    tally = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    totals = (tally.get(True, 0), tally.get(False, 0))
    lexicon = learn_lexicon(known, totals) if all(totals) else {}
    exceptions = learn_exceptions(known, lexicon, totals) if lexicon else []
    beta = np.array([0.0, 0.0, 0.0, -50.0])
    if all(totals):
        share = min(1 << 30, int(1.2 * FIT_ROWS / sum(totals) * (1 << 30)) + 1)
        sample = known.where(F.pmod("pick", F.lit(1 << 30)) < share).select(F.struct("pick", "toxic").alias("mark"), "text")
        seen = measured(sample, lexicon, exceptions, "mark", "struct<pick:bigint,toxic:boolean>")
        rows = seen.select("mark.*", "words", "hits", "weight").orderBy("pick", "toxic", "words", "hits", "weight").limit(FIT_ROWS).toArrow()
        columns = [rows.column(c).to_numpy().astype(float) for c in ("words", "hits", "weight", "toxic")]
        beta = fit_curve(signals(*columns[:3]), columns[3])
    rows = docs.select(packed(docs.select(*[f"`{c}`" for c in carry])).alias("doc"), text_bytes(text).alias("text"))
    found = measured(rows, lexicon, exceptions, "doc", rows.schema["doc"].dataType.simpleString())
    logit = (F.log1p("weight") * float(beta[0]) + F.log1p(100 * F.col("weight") / (F.col("words") + 20.0)) * float(beta[1])
             + (F.col("hits") > 0).cast("double") * float(beta[2]) + float(beta[3]))
    return found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(50.0)), F.lit(-50.0)))))
