"""Language identification of mixed texts: scripts narrow the candidates, then Viterbi over words.

Each word gets a score per language (character trigrams of the word, learned as smoothed log shares). The states of the
Viterbi pass are the languages whose learned words use the word's script; a change of state costs ``SWITCH``. The path
labels spans, and the language that holds most letters is the document's. A text of one language needs no pass: where no
run of words gains more than one change by any other language, the path that never changes is the best one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.llm.common import slices

#: Unicode ranges of the scripts told apart; letters of none of them count as ``other``.
SCRIPTS = {
    "latin": "A-Za-zª-ɏḀ-ỿ", "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ",
    "hebrew": "֐-׿", "arabic": "؀-ۿݐ-ݿ", "devanagari": "ऀ-ॿ", "thai": "฀-๿",
    "hangul": "ᄀ-ᇿ가-힯", "kana": "぀-ヿ", "han": "㐀-䶿一-鿿",
}
SWITCH = 6.0
MIN_COUNT = 3
CACHE_WORDS = 200_000
CACHE_LETTERS = 8_000_000
MAX_ROWS = 30_000
BLOCK_WORDS = 400_000
BLOCK_SCORES = 2_000_000
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")
_SCRIPT = {name: re.compile(f"[{chars}]") for name, chars in SCRIPTS.items()}


def words_of(text: str) -> list[str]:
    """Runs of letters. Numerals such as fractions and circled digits are word characters to Python but no letters."""
    words = _WORD.findall(text)
    return words if all(map(str.isalpha, words)) else _LETTERS.findall(text)


def _gram_keys(first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Three code points of at most 21 bits as one whole number."""
    return first << 42 | middle << 21 | last


@dataclass
class LanguageModel:
    langs: list[str]
    grams: dict[str, np.ndarray]
    unseen: np.ndarray
    scripts: dict[str, np.ndarray]
    cache: dict[str, int] = field(default_factory=dict)
    letters: int = 0
    table: np.ndarray | None = None
    sorted_grams: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "letters": 0, "table": None, "sorted_grams": None}

    def _sorted_grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Known trigrams as ascending whole numbers, and their scores; a last key beyond all stands for unseen ones."""
        if self.sorted_grams is None:
            points = np.array([list(map(ord, g)) for g in self.grams], np.int64).reshape(-1, 3)
            keys = _gram_keys(points[:, 0], points[:, 1], points[:, 2])
            order = np.argsort(keys)
            known = np.array(list(self.grams.values()), np.float64).reshape(len(keys), len(self.langs))[order]
            self.sorted_grams = np.append(keys[order], np.iinfo(np.int64).max), np.vstack([known, self.unseen])
        return self.sorted_grams

    def scores(self, words: list[str]) -> np.ndarray:
        """Log score per language of every word; far below all others outside the candidates of the word's script.

        A word has one trigram around each of its letters, blanks at its ends included.
        """
        keys, known = self._sorted_grams()
        points = np.frombuffer(f" {' '.join(words).lower()} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        letters = np.flatnonzero(points != 32)
        wanted = _gram_keys(points[letters - 1], points[letters], points[letters + 1])
        at = np.searchsorted(keys, wanted)
        at[keys[at] != wanted] = len(keys) - 1
        total = np.add.reduceat(known[at], np.flatnonzero(points[letters - 1] == 32), axis=0)
        firsts, of_word = np.unique([w[0] for w in words], return_inverse=True)
        allowed = np.ones((len(firsts), len(self.langs)), bool)
        for i, first in enumerate(firsts):
            script = next((s for s, p in _SCRIPT.items() if p.match(first)), "other")
            if script in self.scripts:
                allowed[i] = self.scripts[script]
        return np.where(allowed[of_word], total, -1e6)

    def index(self, words: list[str]) -> np.ndarray:
        """Rows of the words in ``table``; new words are scored together, in blocks bounded by their letters."""
        new = list(set(words) - self.cache.keys())
        if len(self.cache) + len(new) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self.cache.clear()
            self.letters, new = 0, list(set(words))
        need = len(self.cache) + len(new)
        if self.table is None or need > len(self.table):
            grown = np.zeros((max(2 * need, 1024), len(self.langs)), np.float32)
            if self.table is not None:
                grown[: len(self.table)] = self.table
            self.table = grown
        room, first, held = max(1, BLOCK_SCORES // len(self.langs)), 0, 0
        for last, word in enumerate(new, 1):
            held += len(word)
            if held >= room or last == len(new):
                block = new[first:last]
                self.table[len(self.cache) : len(self.cache) + len(block)] = self.scores(block)
                self.cache.update(zip(block, range(len(self.cache), len(self.cache) + len(block)), strict=True))
                self.letters += held
                first, held = last, 0
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))


def train_language(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", max_rows: int = MAX_ROWS) -> LanguageModel:
    """Learn from rows with text and language: trigram counts per language, summed by Spark.

    About ``max_rows`` different texts at most are learned from, as many of each language, chosen by a hash of the text:
    a rare language keeps all its texts however many rows the others have, and copies of a text count once.

    Only grams seen ``MIN_COUNT`` times reach the driver, with one count per language; their number is bounded by
    the alphabets in use, not by the rows. Without any row, no language is known and all texts are ``und``.
    """
    lower = F.lower(F.col(text_col))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.col(text_col))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.approx_count_distinct(key).alias("n")).collect()}
    sample = labelled.limit(0)
    if sizes:
        each = max(1, max_rows // len(sizes))
        shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(1_000_000 * min(1.0, each / max(1, n))))])
        sample = labelled.where(F.pmod(key, F.lit(1_000_000)) < F.element_at(shares, F.col(lang_col)))
        sample = sample.select(lang_col, text_col, key.alias("_key")).dropDuplicates([lang_col, "_key"])
    words = sample.select(F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(lower, F.lit(r"(\p{L}+)"), 1)).alias("w"))
    counted = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    padded = counted.select("lang", "n", F.concat(F.lit(" "), "w", F.lit(" ")).alias("p"))
    grams = padded.select("lang", "n", F.explode(F.sequence(F.lit(1), F.length("p") - 2)).alias("i"), "p").select("lang", "n", F.substring("p", F.col("i"), F.lit(3)).alias("g"))
    rows = grams.groupBy("lang", "g").agg(F.sum("n").alias("n")).where(f"n >= {MIN_COUNT}").collect()
    langs = sorted({r["lang"] for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["g"], np.zeros(len(langs)))[at[r["lang"]]] = r["n"]
    total = sum(counts.values(), np.zeros(len(langs)))
    size = total + 0.5 * (len(counts) + 1)
    scripts = {}
    for name, pattern in _SCRIPT.items():
        share = sum((c for g, c in counts.items() if pattern.search(g)), np.zeros(len(langs)))
        if share.sum():
            scripts[name] = share > 0.001 * total
    return LanguageModel(langs, {g: np.log((c + 0.5) / size) for g, c in counts.items()}, np.log(0.5 / size), scripts)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best state per word of each document; the documents advance together, one word a step."""
    order = sorted(range(len(scores)), key=lambda d: -len(scores[d]))
    lengths = np.array([len(scores[d]) for d in order])
    n, states = len(order), scores[0].shape[1]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents with more than t words
    flat = np.concatenate([scores[d] for d in order])
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    back = np.empty(len(flat), dtype=(np.int16, states))
    best = np.zeros((n, states))
    stay = np.arange(states, dtype=np.int16)
    for t in range(lengths[0]):
        k = active[t]
        b = best[:k]
        top = b.argmax(1)
        change = b[np.arange(k), top] - switch
        moved = change[:, None] > b
        at = start[:k] + t
        back[at] = np.where(moved, top[:, None].astype(np.int16), stay)
        best[:k] = np.where(moved, change[:, None], b) + flat[at]
    path = np.empty(len(flat), np.int16)
    state = best.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        path[at] = state[:k]
        state[:k] = back[at, state[:k]]
    out: list[np.ndarray] = [np.empty(0, np.int16)] * n
    for place, d in enumerate(order):
        out[d] = path[start[place] : start[place] + lengths[place]]
    return out


def single_state(scores: np.ndarray, switch: float = SWITCH) -> int:
    """The state of the best path if it never changes, else -1.

    Against the best single state, let no run of words gain more than ``switch`` in any other state. A path with other
    states pays for entering each of its runs as much as the run can gain, so it is no better.
    """
    state = int(scores.sum(0, dtype=np.float64).argmax())
    gain = np.cumsum(scores - scores[:, [state]], axis=0, dtype=np.float64)
    lowest = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    lowest = np.concatenate([np.zeros((1, gain.shape[1])), lowest[:-1]])
    return state if (gain - lowest).max() <= switch else -1


def label_texts(texts: list[str | None], model: LanguageModel) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, share of letters in it, and spans (first word, end word, language) of each text."""
    out: list = [("und", 0.0, [])] * len(texts)
    mixed: list[tuple[int, list[str], np.ndarray]] = []

    def close() -> None:
        if not mixed:
            return
        for (i, words, _), path in zip(mixed, viterbi([s for _, _, s in mixed]), strict=True):
            letters = np.bincount(path, np.fromiter(map(len, words), float, len(path)), len(model.langs))
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            spans = [(a, b, model.langs[path[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            top = int(letters.argmax())
            out[i] = (model.langs[top], float(letters[top] / letters.sum()), spans)
        mixed.clear()

    cut = [words_of(text) if text and model.langs else [] for text in texts]
    ids = model.index([w for words in cut for w in words]) if any(cut) else np.empty(0, np.int64)
    held = start = 0
    for i, words in enumerate(cut):
        if not words:
            continue
        scores = model.table[ids[start : start + len(words)]]
        start += len(words)
        state = single_state(scores)
        if state >= 0:
            out[i] = (model.langs[state], 1.0, [(0, len(words), model.langs[state])])
            continue
        if held + len(words) > BLOCK_WORDS:
            close()
            held = 0
        mixed.append((i, words, scores))
        held += len(words)
    close()
    return out


def _predict(shared, spans: bool, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, text_at):
                labels = label_texts(part.column(text_at).to_pylist(), model)
                cols = [*part.columns, pa.array([x[0] for x in labels], pa.string()), pa.array([x[1] for x in labels], pa.float64())]
                names = [*part.schema.names, "lang_pred", "score"]
                if spans:
                    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                    cols.append(pa.array([[{"first": a, "end": b, "lang": c} for a, b, c in x[2]] for x in labels], kind))
                    names.append("spans")
                keep = [i for i, n in enumerate(names) if n != "_text"]
                yield pa.RecordBatch.from_arrays([cols[i] for i in keep], names=[names[i] for i in keep])

    return run


def identify(docs: DataFrame, model: LanguageModel, *, keys: list[str], text_col: str = "text", spans: bool = False) -> DataFrame:
    """``keys`` of every row with lang_pred, score (share of letters in that language) and on request spans of words.

    Null texts and texts without a letter are ``und`` with score 0. Only ``keys`` and the text are read; ``keys``
    must not be named lang_pred, score, spans or _text. A text column that is a key, too, is sent to the workers once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = text_col in keys
    rows = docs.select(*keys) if own else docs.select(*keys, F.col(text_col).alias("_text"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema] + ["lang_pred string", "score double"])
    return rows.mapInArrow(_predict(shared, spans, keys.index(text_col) if own else len(keys)), fields + (", spans array<struct<first:int,end:int,lang:string>>" if spans else ""))
