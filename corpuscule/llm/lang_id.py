"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton, which accepts exactly the substrings of
that text. A document is parsed against each automaton into phrases, each the longest match from
where the last one ended; few phrases mean that the document looks like that language's text. The
phrases are normalised to bits a character (phrases x log2 of the training length / characters),
and the language needing the fewest wins.

All parses of a batch advance together, one character a step, as gathers from the automata's
transitions. A parse starts anew every ``BLOCK`` characters, for all documents alike, which
bounds the number of steps; every character is parsed.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffer_of, renamed, slices, strings, tidied

#: Labelled rows and characters used per language, at most.
SAMPLE_ROWS = 48
SAMPLE_CHARS = 24_000
#: Characters used for all languages together, at most; it bounds the tables that a worker holds.
TOTAL_CHARS = 2_400_000
#: Languages parsed against at once; further ones in turn.
LANGUAGES_AT_ONCE = 64
#: Characters parsed before a parse starts anew.
BLOCK = 1_024
#: A text is rejected that needs more than what its language's own text needs, plus this share of the way from there
#: to a phrase for every character; SPARE phrases are allowed beyond that, so that short texts' chance counts don't decide.
STRANGE = 0.27
SPARE = 4
#: Letters in each half of a training text from which its own rate is known; else its language rejects nothing.
LEAST_LETTERS = 40

IDENTIFIED = "doc_id long, lang_id string, bits_per_char double, margin double, keep boolean"

_IS_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _IS_LETTER[ord("a")]:
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] in "LM":
                _IS_LETTER[c] = True
    return _IS_LETTER


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a class sequence; state 0 is the root."""
    most = 2 * len(text) + 2
    link, length = [-1] * most, [0] * most
    go: list[dict[int, int]] = [{}]
    last = 0
    for c in text.tolist():
        new = len(go)
        go.append({})
        length[new] = length[last] + 1
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length[copy], link[copy] = length[p] + 1, link[q]
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


def own_rate(text: np.ndarray) -> float:
    """Bits a character that the second half of a class sequence needs against the first; of a very short one, as many as can be."""
    half = len(text) // 2
    if half < LEAST_LETTERS:
        return float(np.log2(max(2, len(text))))
    go, s, n = automaton(text[:half]), 0, 1
    for c in text[half:].tolist():
        to = go[s].get(c)
        if to is None:
            n += s > 0
            to = go[0].get(c, 0)
            n += to == 0
        s = to
    return n * float(np.log2(half)) / (len(text) - half)


def places(degree: np.ndarray, kinds: np.ndarray, classes: int, room: int = 2) -> tuple[np.ndarray, int]:
    """A base for each state, no two alike, such that no two transitions share the cell base + class; the cells needed.

    ``kinds`` has the transitions' classes, state by state. Bases are drawn at random, those of the
    states with many transitions first, while the cells are empty; the first state's is 0.
    """
    first = np.cumsum(degree) - degree
    wide = room * (len(kinds) + len(degree)) + classes
    base, rng = np.full(len(degree), -1), np.random.default_rng(0)
    full, taken, claim = np.zeros(wide + classes, bool), np.zeros(wide, bool), np.zeros(wide + classes, np.int64)
    base[0], taken[0] = 0, True
    full[kinds[: degree[0]]] = True
    for low in (32, 8, 3, 1, 0):
        who = np.flatnonzero((base < 0) & (degree >= low))
        for _ in range(200):
            if not len(who):
                break
            drawn, n = rng.integers(0, wide, len(who)), degree[who]
            row, me = np.repeat(np.arange(len(who)), n), np.arange(len(who))
            cell = kinds[np.repeat(first[who] - (np.cumsum(n) - n), n) + np.arange(n.sum())] + drawn[row]
            claim[drawn] = me
            bad = taken[drawn] | (claim[drawn] != me)
            claim[cell] = row
            bad |= np.bincount(row, full[cell] | (claim[cell] != row), len(who)) > 0
            base[who[~bad]] = drawn[~bad]
            taken[drawn[~bad]] = True
            full[cell[~bad[row]]] = True
            who = who[bad]
        if len(who):
            return places(degree, kinds, classes, 2 * room)
    return base, wide + classes


class Model:
    """Automata of all languages in one sparse table, with the phrase ends marked.

    A state is known by its base. The cell ``base + class`` holds, in its upper half, the base of the
    state whose transition it is and, in its lower half, four times the next state's base plus the
    number of phrases that this character ends. Where the cell isn't this state's, ``fall[class]`` has
    the same for each language: the phrase before the character ends, and the character's own too,
    where it isn't in the training text; the next state is that of the character alone.

    Class 0 is all that isn't a letter, 1 letters in no training text; every other letter has its own.
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        seen = Counter(c for t in texts.values() for c in t if _letters()[ord(c)])
        self.lower = {c: c.lower() if len(c.lower()) == 1 else c for c in seen}
        common: Counter = Counter()
        for c, n in seen.items():
            common[self.lower[c]] += n
        self.alphabet = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
        self.classes = len(self.alphabet) + 2
        cells, falls, roots, bits, own, start = [np.zeros(0, np.int64)], [], [], [], [], 0
        for name in self.languages:
            text = self.sequence(texts[name])
            go = automaton(text)
            first, go[0] = go[0], {c: go[0].get(c, 0) for c in range(self.classes)}
            degree = np.array([len(edges) for edges in go])
            kinds = np.fromiter((c for edges in go for c in edges), np.int64, degree.sum())
            to = np.fromiter((x for edges in go for x in edges.values()), np.int64, degree.sum())
            base, size = places(degree, kinds, self.classes)
            base += start
            state = np.repeat(np.arange(len(go)), degree)
            cell = np.full(size, -1, np.int64)
            cell[base[state] + kinds - start] = (base[state] << 32) | (4 * base[to] + (to == 0))
            cells.append(cell)
            known = np.array([c in first for c in range(self.classes)])
            falls.append((4 * base[to[: self.classes]] + np.where(known, 1, 2)).astype(np.int32))
            roots.append(base[0])
            bits.append(np.log2(max(2, len(text))))
            own.append(own_rate(text))
            start += size
        self.cells, self.fall = np.concatenate(cells), np.column_stack(falls) if falls else np.zeros((self.classes, 0), np.int32)
        self.roots, self.bits, self.own = np.array(roots, np.int64), np.array(bits), np.array(own)

    def most(self, strange: float) -> np.ndarray:
        """Bits a character above which a text isn't in that language."""
        return self.own + strange * np.maximum(0, self.bits - self.own)

    def __getstate__(self) -> dict:
        """Without the look-up table, which each process makes for itself."""
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    @cached_property
    def table(self) -> np.ndarray:
        """Class of each code point, either case."""
        table = _letters().astype(np.int32)
        for i, c in enumerate(self.alphabet):
            for x in {c, c.upper(), c.title()}:
                if len(x) == 1:
                    table[ord(x)] = i + 2
        for c, x in self.lower.items():
            table[ord(c)] = table[ord(x)]
        return table

    def sequence(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.table[points]
        return kinds[(kinds > 0) | (np.concatenate([[1], kinds[:-1]]) > 0)]


def parse(model: Model, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) against each language (columns), by groups of languages."""
    groups = [slice(a, a + LANGUAGES_AT_ONCE) for a in range(0, len(model.roots), LANGUAGES_AT_ONCE)]
    parts = [_parse(model.cells, model.fall[:, g], model.roots[g], kinds, offsets) for g in groups]
    return np.column_stack([np.zeros((len(offsets) - 1, 0), np.int64), *parts])


def _parse(cells: np.ndarray, fall: np.ndarray, roots: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n_lang = len(roots)
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    doc = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[doc] + nth * BLOCK
    left = np.minimum(BLOCK, offsets[doc + 1] - start)
    order = np.argsort(-left, kind="stable")
    doc, start, left = doc[order], start[order], left[order]
    lanes = np.tile(roots, (len(doc), 1)).astype(np.int64)
    count = np.zeros((len(doc), n_lang), np.int32)
    alive = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
    for t, m in enumerate(alive.tolist()):
        at, kind = lanes[:m], kinds[start[:m] + t]
        cell = cells[at + kind[:, None]]
        to = np.where((cell >> 32) == at, cell & 0xFFFFFFFF, fall[kind])
        count[:m] += to & 3
        np.right_shift(to, 2, out=at)
    total = np.zeros((len(lengths), n_lang), np.int64)
    np.add.at(total, doc, count + (lanes != roots[None, :]))  # the phrase that is open at the end of a block
    return total


def classify(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits a character of each text for each language; its parsed characters; its letters."""
    data, offsets = buffer_of(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    offsets = lead[offsets]
    kinds = model.table[points]
    keep = np.empty(len(kinds), bool)
    if len(kinds):
        keep[0] = True
        keep[1:] = (kinds[1:] > 0) | (kinds[:-1] > 0)
    to = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(kinds > 0)])
    kinds, n_letters, offsets = kinds[keep].astype(np.int64), np.diff(letters[offsets]), to[offsets]
    n = np.diff(offsets)
    return parse(model, kinds, offsets) * model.bits[None, :] / np.maximum(n, 1)[:, None], n, n_letters


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of the languages named in ``docs(doc_id, text, lang)``.

    Per language it takes the labelled rows of lowest hash, ``sample_rows`` at most, and of their
    text ``sample_chars`` at most; all languages share ``TOTAL_CHARS`` evenly where there are so many
    that this is less. Every label gets a model. Rows without label, id or text don't count.
    """
    rows = renamed(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    keys = rows.where("lang is not null and lang <> '' and text is not null and doc_id is not null")
    keys = keys.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.least(F.length("text"), F.lit(sample_chars)).alias("n"))
    keys = keys.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_rows)
    keys = keys.withColumn("before", F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, -1)))
    keys = keys.where(F.coalesce("before", F.lit(0)) < sample_chars)  # no more than is used
    chosen = [(r.lang, r.doc_id) for r in keys.orderBy("lang", "nth").select("lang", "doc_id").collect()]
    texts: dict[str, str] = {}
    if chosen:
        found = rows.where(F.col("doc_id").isin([i for _, i in chosen]) & F.col("lang").isNotNull())
        found = found.select("lang", "doc_id", F.substring("text", 1, sample_chars).alias("text")).dropDuplicates(["lang", "doc_id"])
        by = {(r.lang, r.doc_id): r.text for r in found.collect()}
        sample_chars = min(sample_chars, TOTAL_CHARS // len({lang for lang, _ in chosen}))
        for lang, i in chosen:
            if len(texts.get(lang, "")) < sample_chars and (lang, i) in by:
                texts[lang] = (texts.get(lang, "") + " " + (by[lang, i] or ""))[:sample_chars]
    return Model(texts)


def _identifier(shared, strange: float) -> Callable:
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        most, spare = np.append(model.most(strange), 0.0), np.append(SPARE * model.bits, 0.0)
        names = np.array([*model.languages, None], object)
        for batch in tidied(batches):
            texts = strings(batch.column(1))
            for a, b in slices(texts, 2 << 20):
                rate, n, letters = classify(model, texts.slice(a, b - a))
                if len(names) > 1:
                    best = rate.argmin(1)
                    least = rate[np.arange(len(rate)), best]
                    second = np.sort(rate, 1)[:, 1] if rate.shape[1] > 1 else least
                else:
                    best, least, second = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n))
                none = letters == 0
                best = np.where(none, len(names) - 1, best)
                rejected = none | (least * n > most[best] * n + spare[best])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(names[best].tolist(), pa.string()),
                        pa.array(np.where(none, 0.0, least), pa.float64(), mask=none),
                        pa.array(np.where(none, 0.0, second - least), pa.float64(), mask=none),
                        pa.array(~rejected),
                        *(batch.column(i).slice(a, b - a) for i in range(2, batch.num_columns)),
                    ],
                    ["doc_id", "lang_id", "bits_per_char", "margin", "keep", *batch.schema.names[2:]],
                )

    return identify


def identify_languages(docs: DataFrame, model: Model | None = None, strange: float = STRANGE) -> DataFrame:
    """``doc_id, lang_id, bits_per_char, margin, keep`` for each row of ``docs(doc_id, text, lang, …)``.

    ``margin`` is how many bits a character the second language needs more. A text without letters
    (null and empty ones too) has no language and isn't kept; nor is one that needs more bits than its
    language's own text does, plus ``strange`` of the way from there to a phrase a character, plus
    ``SPARE`` phrases. Ties go to the language first in the alphabet. A very long text is parsed whole,
    like any other. Repeated rows each give a row, a null ``doc_id`` stays null, other columns are
    ignored, an empty table gives no rows. Without labelled rows, all texts with letters have a null
    language and are kept.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return renamed(docs, {"doc_id": "long", "text": "string"}).mapInArrow(_identifier(shared, strange), IDENTIFIED)


def keep_identified(docs: DataFrame, model: Model | None = None, strange: float = STRANGE) -> DataFrame:
    """The rows of ``docs`` that ``identify_languages`` keeps, with their own columns, whatever these are called.

    Null, empty and unlettered texts go; a null ``doc_id`` or ``lang`` doesn't matter; each of repeated
    rows is kept or goes like the others; very long texts are parsed whole; an empty table stays empty.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    identify = _identifier(shared, strange)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            key = pa.array(np.arange(batch.num_rows))
            only = pa.RecordBatch.from_arrays([key, batch.column(at)], ["doc_id", "text"])
            good = np.concatenate([np.zeros(0, bool), *(out.column(4).to_numpy(zero_copy_only=False) for out in identify(iter([only])))])
            yield batch.filter(pa.array(good))

    at = docs.columns.index("text")
    return docs.mapInArrow(keep, docs.schema)
