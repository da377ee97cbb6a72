"""Language identification by cross-parsing.

A suffix automaton of each language's labelled text gives, at every place of a document, the longest match with that
text. The document is parsed into such matches. A phrase points into the labelled text, which takes as many bits as the text's length
has: the language whose phrases times that need the fewest bits wins.
Each automaton knows all characters of its own text. Narrow ones are laid out as tables in which a failed step already
leads to the start of the next phrase, wide ones as sorted keys, so many documents advance one character with a few array
operations.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.llm import scratch

#: Labelled characters an automaton is fitted on, at most, and how many one labelled text gives, from its first letter on.
SAMPLE_CHARS = 40_000
SAMPLE_TEXT = 4_000
#: Labelled documents read per language.
SAMPLE_DOCS = 64
#: Entries of all tables together; automata that would go beyond are laid out as sorted keys, with the same results.
DENSE = 1 << 25
#: Parsing starts anew at each such place of a text.
BLOCK = 1024
UNKNOWN = "und"
#: Runs of digits, punctuation and blanks, which tell no language: one space each in labelled texts and in those to be told.
APART = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u206f\u3000-\u303f]+")


def automaton(text: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of states, and steps as states, character classes and next states. State 0 is the start."""
    steps, links, lengths, last = [{}], [-1], [0], 0
    for c in text.tolist():
        now = len(steps)
        steps.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = now
            p = links[p]
        if p >= 0:
            q = steps[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[now] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = links[p]
                links[q] = links[now] = copy
        last = now
    state, char, goes = (np.array(x, np.int32) for x in zip(*((i, c, t) for i, out in enumerate(steps) for c, t in out.items()), strict=True)) if steps[0] else (np.zeros(0, np.int32),) * 3
    return len(steps), state, char, goes


class Automaton:
    """A language's automaton over the characters of its own text; all other characters share the last class."""

    def __init__(self, text: str):
        chars = _points(text)
        self.points = np.unique(chars)
        self.bits = math.log2(max(2, len(chars)))
        self.width = len(self.points) + 1
        self.states, *self.steps = automaton(self.classes(chars))
        self.table = self.keys = None

    def size(self) -> int:
        return (self.states + 1) * self.width

    def lay_out(self, dense: bool) -> None:
        """A failed step is ~state: the character ends a phrase and starts another one."""
        state, char, goes = self.steps
        dead = self.states  # after a character that the text doesn't have: the next one starts a phrase
        self.start = np.full(self.width, dead, np.int32)
        self.start[char[state == 0]] = goes[state == 0]
        if dense:
            table = np.repeat(~self.start[None], self.states + 1, 0)
            table[state, char] = goes
            table[0] = self.start
            self.table = table.ravel()
        else:
            keys = state.astype(np.int64) * self.width + char
            order = np.argsort(keys)
            self.keys, self.goes = keys[order], goes[order]
        self.steps = None

    def classes(self, chars: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.zeros(len(chars), np.int32)
        at = np.searchsorted(self.points, chars).astype(np.int32)
        at[at == len(self.points)] = 0
        return np.where(self.points[at] == chars, at, len(self.points)).astype(np.int32)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.width + char]
        start = self.start[char]
        if not len(self.keys):
            return np.where(state == 0, start, ~start)
        key = state.astype(np.int64) * self.width + char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.goes[at], np.where(state == 0, start, ~start))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """languages, and their automata in the same order."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.automata = [Automaton("\n".join(samples[k]).lower()[:SAMPLE_CHARS]) for k in self.languages]
        room = DENSE
        for a in sorted(self.automata, key=Automaton.size):
            a.lay_out(a.size() <= room)
            room -= a.size()

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases by text and language."""
        lowered = [x.lower() for x in texts]
        points, sizes = _points("".join(lowered)), np.array([len(x) for x in lowered], np.int64)
        counts = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = (np.cumsum(sizes) - sizes)[owner] + number * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        n, wide = len(order), len(self.languages)
        broken = np.zeros((wide, n), np.int32)
        active = np.searchsorted(-length, -np.arange(length[0] if n else 0), "left").tolist()  # blocks longer than i
        for a, count in zip(self.automata, broken, strict=True):
            chars, state = a.classes(points), np.zeros(n, np.int32)
            for i, m in enumerate(active):
                now = a.step(state[:m], chars[begin[:m] + i])
                over = now >> 31
                count[:m] -= over
                state[:m] = now ^ over
        out = np.zeros((len(texts), wide), np.int64)
        np.add.at(out, owner[order], broken.T + 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores from 0 to 1: by how much fewer bits the best needs than the second best; ties go to the first name."""
        some = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))] if self.languages else []
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if some:
            found = self.phrases([APART.sub(" ", texts[i]) for i in some]) * np.array([a.bits for a in self.automata])
            best = found.argmin(1)
            ranked = np.sort(found, 1)
            score = 1 - ranked[:, 0] / ranked[:, 1] if len(self.languages) > 1 else np.ones(len(some))
            for i, b, s in zip(some, best.tolist(), score.tolist(), strict=True):
                names[i], scores[i] = self.languages[b], s
        return names, scores


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Texts of each language from its SAMPLE_DOCS documents with the least hashes: SAMPLE_TEXT characters of each at most.

    Only ids and hashes of texts meet the window; Spark limits groups before the shuffle, so a language that most rows have stays small.
    Rows that are wholly equal are collected once.
    """
    fit = docs.where("text is not null and lang is not null and trim(text) <> ''").select("doc_id", "lang", "text", F.xxhash64("text").alias("row"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "row")
    ids = fit.select("doc_id", "lang", "row").withColumn("i", F.row_number().over(first)).where(f"i <= {SAMPLE_DOCS}").select("doc_id", "row").distinct()
    part = F.expr(rf"substring(text, greatest(regexp_instr(text, '\\p{{L}}'), 1), {SAMPLE_TEXT})").alias("text")
    chosen = {tuple(r) for r in ids.collect()}  # SAMPLE_DOCS for each language at most
    some = fit.where(F.col("doc_id").isin([i for i, _ in chosen]) & F.col("row").isin([h for _, h in chosen]))
    rows = [r for r in some.groupBy("doc_id", "lang", "row").agg(F.first(part).alias("text")).collect() if (r.doc_id, r.row) in chosen]
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.doc_id, r.text)):
        out.setdefault(row.lang, []).append(APART.sub(" ", row.text))
    return out


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score. Null text, or one without a letter, is `und` with score 0, as is all without labels."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, scores, i = batch.column("text").to_pylist(), [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= 1 << 22):
                    size += len(texts[j] or "")
                    j += 1
                for xs, more in zip((names, scores), shared.value.predict(texts[i:j]), strict=True):
                    xs += more
                i = j
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(f.name for f in kept), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double"])
    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, schema)


def fit(docs: DataFrame) -> Model:
    """Fitted on the labelled documents whose crc32 remainder isn't 2."""
    return Model(sample(docs.where(remainder() != 2)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each row of `documents`, repeats of a doc_id too; fitted on those whose remainder isn't 2. Nulls and empty tables as in identify()."""
    docs = scratch.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (remainder() == 2).alias("held_out"), "lang_pred", "score")
