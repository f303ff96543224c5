"""Language ID by cross-parsing: the language whose labelled text needs the fewest phrases to spell a text wins.

A suffix automaton of each language's sample follows the text from its root as far as some substring of the sample goes (the longest match);
there a phrase ends and the next begins; a symbol that the sample lacks is a phrase of its own. Phrases over text length are compared
without a factor for the sample's length: with log(length), phrases of a tiny sample would cost next to nothing and it would win texts of all
languages. Samples are bounded: ``per_lang`` labelled documents of a language, chosen by a hash of the id, and a stretch of ``chars``
characters of each, from a place in the whole text chosen by a hash. The ``LETTERS`` most frequent letters of all samples are told apart, rarer
ones are one symbol. Every whole text is parsed, in stretches of ``STRETCH`` symbols that begin with a new phrase each; numpy
walks many stretches and all languages in step through dense transition tables.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything where nothing can be learned; rows with a null id
or language teach nothing; equal numbers of phrases go to the language first by code point; repeated rows are rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.ranking import top_n

#: Symbols that are parsed in one go, stretches that are walked together, and letters of the alphabet (others match nothing).
STRETCH, TOGETHER, LETTERS = 1024, 2048, 62
BLANK, STRANGE = 0, 1
_letter: list[np.ndarray] = []
_built: dict[int, "Parser"] = {}


def remainder(id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 3."""
    return F.crc32(id.cast("string").cast("binary")) % 3


def samples(docs: DataFrame, per_lang: int = 64, chars: int = 512, id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """The labelled text of each language that the automata are built of; at most per_lang * chars characters each."""
    whole = F.col(text).cast("string")
    place = F.pmod(F.xxhash64(F.col(id), whole), F.greatest(F.length(whole) - chars, F.lit(0)) + 1) + 1
    known = docs.select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), whole.substr(place.cast("int"), F.lit(chars)).alias("text"))
    some = top_n(known.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"), ("lang",),
                 [F.xxhash64("id"), F.col("id"), F.col("text")], per_lang)
    out: dict[str, list[str]] = {}
    for row in some.select("lang", "text", "pos").orderBy("lang", "pos").collect():
        out.setdefault(row.lang, []).append(row.text)
    return out


def predict(docs: DataFrame, learned: dict[str, list[str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, lang_pred, score` per row of `docs`; the score is the share by which the fewest phrases are below the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(learned)
        for batch in batches:
            langs, scores = [], []
            for lo in range(0, batch.num_rows, 512):
                for lang, score in parser.best([t or "" for t in batch.column("text").slice(lo, 512).to_pylist()]):
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def _parser(learned: dict[str, list[str]]) -> "Parser":
    """One parser per worker and model."""
    key = hash(tuple((k, *v) for k, v in learned.items()))
    if key not in _built:
        _built.clear()
        _built[key] = Parser(learned)
    return _built[key]


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letter[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Parser:
    def __init__(self, learned: dict[str, list[str]]):
        self.langs = sorted(learned, key=str.encode)
        points = np.concatenate([np.zeros(0, np.uint32), *(_points(t) for ts in learned.values() for t in ts)])
        values, counts = np.unique(points[_letters()[points]], return_counts=True)
        common = values[np.lexsort((values, -counts))][:LETTERS]
        self.symbol = np.where(_letters(), STRANGE, BLANK).astype(np.uint8)
        self.symbol[common] = np.arange(2, 2 + len(common))
        self.width = 2 + len(common)
        tables = []
        for lang in self.langs:
            text = self.symbols(" ".join(learned[lang]))
            tables.append(automaton(text.tolist(), self.width))
        self.roots = np.cumsum([0, *(len(t) for t in tables)])[:-1]
        self.steps = np.concatenate([np.zeros((0, self.width), np.int64), *(_steps(t, root) for t, root in zip(tables, self.roots, strict=True))]).ravel()

    def symbols(self, text: str) -> np.ndarray:
        """Letters as symbols, every run of other characters as one blank."""
        out = self.symbol[_points(text)]
        if len(out):
            out = out[np.concatenate([[True], (out[1:] != BLANK) | (out[:-1] != BLANK)])]
        return out

    def best(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        spelled = [self.symbols(t) for t in texts]
        sizes = np.array([len(s) for s in spelled])
        flat = np.concatenate([*spelled, np.zeros(STRETCH, np.uint8)])
        base = np.cumsum(sizes) - sizes
        starts = np.concatenate([np.arange(b, b + n, STRETCH) for b, n in zip(base, sizes, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), -(-sizes // STRETCH))
        ends = np.minimum(starts + STRETCH, (base + sizes)[owner])
        phrases = np.zeros((len(self.langs), len(texts)), np.int64)
        order = np.argsort(starts - ends, kind="stable")
        for lo in range(0, len(order), TOGETHER):
            some = order[lo:lo + TOGETHER]
            counts = self._walk(flat, starts[some], (ends - starts)[some])
            for i in range(len(self.langs)):
                phrases[i] += np.bincount(owner[some], counts[i], len(texts)).astype(np.int64)
        for i, s in enumerate(spelled):
            if not len(self.langs) or not (s != BLANK).any():
                yield "und", 0.0
                continue
            at = int(phrases[:, i].argmin())
            rest = np.delete(phrases[:, i], at)
            yield self.langs[at], float(1 - phrases[at, i] / rest.min()) if len(rest) else 1.0

    def _walk(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases per language and stretch; stretches come longest first."""
        state = np.repeat(self.roots[:, None], len(starts), axis=1)
        counts = np.zeros_like(state)
        for t in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -t, "left"))  # stretches longer than t
            step = self.steps[state[:, :n] * self.width + flat[starts[:n] + t]]
            counts[:, :n] += step & 3
            state[:, :n] = step >> 2
        counts += state != self.roots[:, None]  # the phrase that the end cuts off
        return counts


def automaton(text: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a text: a row per state, -1 where no substring goes on."""
    size = 2 * len(text) + 2
    go = [None] * size
    link, length = [-1] * size, [0] * size
    go[0] = {}
    used, last = 1, 0
    for c in text:
        new = used
        used += 1
        go[new], length[new] = {}, length[last] + 1
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = used
                used += 1
                go[twin], length[twin], link[twin] = dict(go[q]), length[p] + 1, link[q]
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out = np.full((used, width), -1, np.int64)
    for state in range(used):
        for c, to in go[state].items():
            out[state, c] = to
    return out


def _steps(table: np.ndarray, root: int) -> np.ndarray:
    """Next state times 4, plus the phrases that end: where no substring goes on, the symbol begins a new phrase at the root, or is one itself."""
    fresh = table[0]
    begins = np.where(fresh >= 0, (np.maximum(fresh, 0) + root) * 4 + 1, root * 4 + 2)
    steps = np.where(table >= 0, (table + root) * 4, begins[None, :])
    steps[0] = np.where(fresh >= 0, (fresh + root) * 4, root * 4 + 1)
    return steps
