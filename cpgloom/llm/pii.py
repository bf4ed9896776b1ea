"""Personal information in free text by weak-supervision aggregation (problem 8).

1. One pass learns words: names that follow strong cues, and words that are common.
2. Regex, gazetteer and context labelers vote on candidate spans of every text; the candidates are kept.
3. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and
   gives every pattern a probability.
4. A span classifier (logistic regression on hashed votes and context) is trained on those
   probabilities with a bounded sample of candidates. Each person of the sample is also shown as if its
   names were in no gazetteer, so that the classifier learns to decide on unseen names by their context.
5. The classifier decides on every kept candidate; overlaps go to the better one. Texts are searched once.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, keep, spread
from .pii_spans import KINDS, LABELERS, Lexicon, Span, find_spans, looked_up, name_evidence

#: Candidates per kind that the classifier is trained on: those with the smallest hash.
TRAINING_ROWS = 20_000
#: A name needs this many documents that show it behind a cue, whatever the size of the corpus ...
NAME_DOCS = 2
#: ... and this share of the documents that hold the word.
NAME_PURITY = 0.1
#: A gazetteer of up to this many names (some 100 bytes each in a worker) is broadcast; a larger one is
#: joined to the texts that hold its names.
BROADCAST_NAMES = 500_000
#: A word in this share of all documents is common (so there are at most a few hundred thousand).
COMMON_DOCS, COMMON_SHARE = 10, 0.002
DIMENSIONS = 1 << 16
THRESHOLD = 0.5
PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>", "address": "<ADDRESS>", "person": "<PERSON>"}
#: A kind's strength where overlapping spans are equally likely.
_ORDER = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "person": 4}


@dataclass
class Words:
    """What was learned about words. ``lexicon`` holds the common words and, unless they are too many to
    broadcast, the names; else ``names`` is their table (``word, g, f``)."""

    lexicon: Lexicon
    names: DataFrame | None = None


def learn_words(documents: DataFrame, text: str = "text", broadcast_names: int = BROADCAST_NAMES) -> Words:
    """Names and common words of the corpus; counts cover every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, family, words, docs = Counter(), Counter(), Counter(), 0
            for t in batch.column(0).to_pylist():
                if t:
                    g, f, w = name_evidence(t)
                    given.update(g)
                    family.update(f)
                    words.update(w | g | f)
                    docs += 1
            words[""] = docs
            keys = list(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.string()),
                    pa.array([words[k] for k in keys], pa.int64()),
                    pa.array([given[k] for k in keys], pa.int64()),
                    pa.array([family[k] for k in keys], pa.int64()),
                ],
                names=["word", "docs", "given", "family"],
            )

    rows = spread(documents.select(F.col(f"`{text}`"))).mapInArrow(count, "word string, docs long, given long, family long")
    totals = cut_lineage(
        rows.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("given").alias("given"), F.sum("family").alias("family"))
    )
    n = totals.where("word = ''").agg(F.max("docs")).first()[0] or 0
    name = lambda c: (F.col(c) >= NAME_DOCS) & (F.col(c) >= NAME_PURITY * F.col("docs"))
    marked = totals.where("word <> ''").select("word", "docs", name("given").alias("g"), name("family").alias("f"))
    common = frozenset(r["word"] for r in marked.where(F.col("docs") >= max(COMMON_DOCS, COMMON_SHARE * n)).collect())  # bounded by the share
    names = cut_lineage(marked.where("g OR f").select("word", "g", "f"))
    if names.count() > broadcast_names:
        return Words(Lexicon(common=common), names)
    kept = names.collect()
    pick = lambda k: frozenset(r["word"] for r in kept if r[k])
    return Words(Lexicon(pick("g"), pick("f"), common))


def _with_names(src: DataFrame, names: DataFrame) -> DataFrame:
    """Add to each text ``t__`` the names of the table that it holds, as ``g__`` and ``f__``. Texts are known
    by their digest, so equal texts are looked up together."""
    digest = src.withColumn("d__", F.sha2("t__", 256))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(*(c.to_pylist() for c in batch.columns)):
                found = sorted(looked_up(t)) if t else []
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(found), pa.string()), pa.array(found, pa.string())], names=["d__", "word"])

    held = digest.where("t__ <> ''").select("d__", "t__").mapInArrow(words, "d__ string, word string").distinct()
    mine = held.join(names, "word").groupBy("d__").agg(
        *[F.collect_set(F.when(F.col(c), F.col("word"))).alias(f"{c}__") for c in "gf"]  # at most the words of one text
    )
    return digest.join(mine, "d__", "left").drop("d__")


# ---------------------------------------------------------------- expectation-maximisation


def aggregate_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, prior: float = 0.02) -> np.ndarray:
    """Probability that a candidate with each vote pattern (rows of -1, 0, 1) is true.

    Dawid and Skene's model with two classes: labelers vote independently given the truth, each with
    its own rates. The prior, a small share of all candidates, says that +1 speaks for and -1 against;
    it fixes which class is which. No pattern gives an empty result.
    """
    if not len(patterns):
        return np.zeros(0)
    n = counts.astype(float)
    score = patterns.sum(axis=1)
    q = 1 / (1 + np.exp(-(2.0 * score - 3.0)))
    weight = max(1.0, prior * n.sum())
    hot = np.stack([(patterns == v) for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, vote
    lean = {1: np.array([0.1, 0.35, 0.55]) * weight, 0: np.array([0.55, 0.35, 0.1]) * weight}
    for _ in range(rounds):
        logs = []
        share = (n @ q + 1) / (n.sum() + 2)
        for z, r in ((1, q), (0, 1 - q)):
            rate = np.einsum("p,plv->lv", n * r, hot) + lean[z]
            rate /= rate.sum(axis=1, keepdims=True)
            logs.append(np.einsum("plv,lv->p", hot, np.log(rate)) + math.log(share if z else 1 - share))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        if np.abs(new - q).max() < 1e-6:
            q = new
            break
        q = new
    return q


# ---------------------------------------------------------------- span classifier


def feature_slots(kind: str, form: str, votes: tuple, features: tuple) -> list[int]:
    names = [f"{kind}|{form}", f"{kind}|bias"]
    names += [f"{kind}|{name}={v}" for name, v in zip(LABELERS[kind], votes)]
    names += [f"{kind}|{f}" for f in features]
    return [zlib.crc32(x.encode()) % DIMENSIONS for x in names]


def train_classifier(rows: list[tuple[list[int], float]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on sparse slots with soft targets, by full-batch adaptive gradient steps."""
    w = np.zeros(DIMENSIONS)
    if not rows:
        return w
    lengths = np.array([len(s) for s, _ in rows])
    slots = np.concatenate([np.array(s) for s, _ in rows])
    owner = np.repeat(np.arange(len(rows)), lengths)
    y = np.array([t for _, t in rows])
    seen = np.full(DIMENSIONS, 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, weights=w[slots], minlength=len(rows))
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(slots, weights=miss[owner], minlength=DIMENSIONS) / len(rows) + ridge * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _slots(s: Span) -> tuple[list[int], list[int] | None]:
    votes = s.votes if s.scored is None else s.scored
    return feature_slots(s.kind, s.form, votes, s.features), None if s.masked is None else feature_slots(s.kind, s.form, *s.masked)


@dataclass
class PiiModel:
    words: Words
    weights: np.ndarray
    patterns: dict = field(default_factory=dict)  # (kind, votes) -> probability, of every pattern of the corpus

    def probabilities(self, kinds: list, votes: list, unseen: list, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The classifier's, which saw context; averaged with the patterns' own where the classifier is
        unsure and the gazetteers had a say."""
        if not len(sizes):
            return np.zeros(0)
        z = np.add.reduceat(self.weights[slots], np.cumsum(sizes) - sizes)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for i in np.flatnonzero((p > 0.2) & (p < 0.8)):
            if not unseen[i]:
                p[i] = (p[i] + self.patterns.get((kinds[i], votes[i]), p[i])) / 2
        return p

    def decide(self, text: str) -> list[Span]:
        """Accepted spans of one text (names from the broadcast gazetteer)."""
        spans = find_spans(text, self.words.lexicon)
        slots = [_slots(s)[0] for s in spans]
        p = self.probabilities(
            [s.kind for s in spans], [_pack(s.votes) for s in spans], [_is_unseen(s) for s in spans],
            np.array([x for y in slots for x in y], np.int64), np.array([len(x) for x in slots], np.int64),
        )
        return [spans[i] for i in choose(p, [s.kind for s in spans], [s.start for s in spans], [s.end for s in spans])]


def choose(p, kinds: list, starts: list, ends: list) -> list[int]:
    """Accepted spans of a text in order, without overlaps: the likelier wins, then the longer one."""
    at = [i for i in range(len(p)) if p[i] >= THRESHOLD]
    at.sort(key=lambda i: (-round(float(p[i]), 1), starts[i] - ends[i], _ORDER[kinds[i]], starts[i]))
    taken: list[tuple[int, int, int]] = []
    for i in at:
        k = bisect_left(taken, (starts[i],))
        if (k == len(taken) or ends[i] <= taken[k][0]) and (k == 0 or taken[k - 1][1] <= starts[i]):
            taken.insert(k, (starts[i], ends[i], i))
    return [i for _, _, i in taken]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with its (start, end, kind) spans, in order, replaced by placeholders."""
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def _pack(votes: tuple) -> str:
    return "".join("-0+"[v + 1] for v in votes)


def _unpack(votes: str) -> tuple:
    return tuple("-0+".index(c) - 1 for c in votes)


def _is_unseen(s: Span) -> bool:
    return s.kind == "person" and s.masked is None


_SPAN = {
    "kind": pa.string(), "start": pa.int32(), "end": pa.int32(), "surface": pa.string(), "votes": pa.string(), "unseen": pa.bool_(), "h": pa.int64(),
    "slots": pa.list_(pa.int32()), "masked": pa.list_(pa.int32()),
}
_SPAN_DDL = "array<struct<kind:string,start:int,end:int,surface:string,votes:string,unseen:boolean,h:bigint,slots:array<int>,masked:array<int>>>"


def candidates(documents: DataFrame, words: Words, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``<key>, [<text>,] spans``: the candidate spans of every text with their votes and feature slots. Without
    the text, documents that have none are left out."""
    shared = documents.sparkSession.sparkContext.broadcast(words.lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            own = [c.to_pylist() for c in batch.columns[2:4]]
            rows, sizes, some = [], [], []
            for i, t in enumerate(texts):
                lex = common if not own else Lexicon(frozenset(own[0][i] or ()), frozenset(own[1][i] or ()), common.common)
                spans = find_spans(t, lex) if t else []
                for s in spans:
                    surface = t[s.start : s.end]
                    h = zlib.crc32(f"{keys[i]}|{s.kind}|{surface}|{s.start}".encode())
                    rows.append((s.kind, s.start, s.end, surface, _pack(s.votes), _is_unseen(s), h, *_slots(s)))
                if spans or with_text:
                    some.append(i)
                    sizes.append(len(spans))
            cols = list(zip(*rows)) if rows else [[]] * len(_SPAN)
            flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, _SPAN.values())], names=list(_SPAN))
            ends = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes, out=ends[1:])
            spans = pa.ListArray.from_arrays(pa.array(ends), flat)
            out = [keys.take(pa.array(some, pa.int64()))]
            if with_text:
                out.append(batch.column(1))
            yield pa.RecordBatch.from_arrays([*out, spans], names=[key, *([text] if with_text else []), "spans"])

    src = spread(documents.select(F.col(f"`{key}`").alias("k__"), F.col(f"`{text}`").alias("t__")))
    src = src if words.names is None else _with_names(src, words.names).select("k__", "t__", "g__", "f__")
    kind = documents.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, {f'`{text}` string, ' if with_text else ''}spans {_SPAN_DDL}")


def train(found: DataFrame, words: Words, training_rows: int = TRAINING_ROWS) -> PiiModel:
    """Labeler reliabilities and the classifier from kept candidates. Only counts per vote pattern (at most 3
    to the number of labelers) and the training sample come to the driver."""
    cand = found.select(F.inline("spans"))
    counted: dict[str, list[tuple[str, int]]] = {k: [] for k in KINDS}
    for r in cand.groupBy("kind", "votes").count().collect():
        counted[r["kind"]].append((r["votes"], r["count"]))
    patterns: dict = {}
    for kind, rows in counted.items():
        q = aggregate_votes(np.array([_unpack(v) for v, _ in rows]).reshape(len(rows), len(LABELERS[kind])), np.array([c for _, c in rows]))
        patterns |= {(kind, v): float(p) for (v, _), p in zip(rows, q)}
    drawn = F.lit(False)  # hashes are even, so about a tenth more than wanted is drawn, and the smallest are taken
    for kind, rows in counted.items():
        n = sum(c for _, c in rows)
        drawn = drawn | ((F.col("kind") == kind) & (F.col("h") < int((1 << 32) * min(1.0, 1.1 * training_rows / max(n, 1)))))
    sample: dict[str, list] = {k: [] for k in KINDS}
    for r in cand.where(drawn).select("kind", "h", "votes", "slots", "masked").collect():
        sample[r["kind"]].append((r["h"], r["votes"], r["slots"], r["masked"] or ()))
    training = []
    for kind, rows in sample.items():
        for _, votes, slots, masked in sorted(rows)[:training_rows]:
            training.append((slots, patterns[kind, votes]))
            if masked:
                training.append((masked, patterns[kind, votes]))
    return PiiModel(words, train_classifier(training), patterns)


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", training_rows: int = TRAINING_ROWS) -> PiiModel:
    """Learn words, labeler reliabilities and the classifier from the corpus itself."""
    words = learn_words(documents, text)
    return train(keep(candidates(documents, words, key, text)), words, training_rows)


def _searched(documents: DataFrame, model: PiiModel | None, key: str, text: str, with_text: bool) -> tuple[DataFrame, PiiModel]:
    """Candidates and a model; texts are searched once, also where the model is learned from them."""
    if model is not None:
        return candidates(documents, model.words, key, text, with_text), model
    words = learn_words(documents, text)
    found = keep(candidates(documents, words, key, text, with_text))
    return found, train(found, words)


def _chosen(model: PiiModel, spans: pa.ListArray) -> Iterator[list[tuple[int, int, str, str]]]:
    """Accepted (start, end, kind, surface) of each row."""
    flat = spans.flatten()
    col = {c: flat.field(c) for c in ("kind", "start", "end", "surface", "votes", "unseen")}
    kinds, starts, ends, surfaces, votes, unseen = (c.to_pylist() for c in col.values())
    slots = flat.field("slots")
    p = model.probabilities(kinds, votes, unseen, slots.flatten().to_numpy(), slots.value_lengths().to_numpy())
    at = 0
    for n in spans.value_lengths().to_pylist():
        here = slice(at, at + (n or 0))
        yield [(starts[at + i], ends[at + i], kinds[at + i], surfaces[at + i]) for i in choose(p[here], kinds[here], starts[here], ends[here])]
        at = here.stop


def find_personal_data(documents: DataFrame, model: PiiModel | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, kind, surface``: one row for each distinct piece of personal data of a text. Null and
    empty texts have none; texts of any length are searched whole. Repeated rows give repeated rows."""
    found, model = _searched(documents, model, key, text, False)
    shared = documents.sparkSession.sparkContext.broadcast(PiiModel(Words(Lexicon()), model.weights, model.patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, surfaces = [], [], []
            for i, chosen in enumerate(_chosen(shared.value, batch.column(1))):
                for kind, surface in sorted({x[2:] for x in chosen}):
                    at.append(i)
                    kinds.append(kind)
                    surfaces.append(surface)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(surfaces, pa.string())],
                names=[key, "kind", "surface"],
            )

    return found.mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, kind string, surface string")


def redact_documents(documents: DataFrame, model: PiiModel | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, <text>, n_replaced``: every text with typed placeholders, the rest unchanged. A null text
    stays null, an empty one empty."""
    found, model = _searched(documents, model, key, text, True)
    shared = documents.sparkSession.sparkContext.broadcast(PiiModel(Words(Lexicon()), model.weights, model.patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [[x[:3] for x in c] for c in _chosen(shared.value, batch.column(2))]
            done = [redact(t, c) if c else t for t, c in zip(batch.column(1).to_pylist(), chosen)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(done, pa.string()), pa.array([len(c) for c in chosen], pa.int64())], names=[key, text, "n_replaced"]
            )

    return found.mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, `{text}` string, n_replaced long")
