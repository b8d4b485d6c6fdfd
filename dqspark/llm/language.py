"""Language of words, spans and texts.

Words are runs of letters and their marks, lower case.  A word is scored for every language by the letter
groups of one to four (with the word's borders) and the whole word, each counted in hashed
``SLOTS`` of the learned texts: naive Bayes with a small addition to every count.  Counts are
gathered by one pass in which each task adds up its own texts; the driver holds one number a
slot and language.

The script of a word's first letter, found in Unicode ranges, narrows the candidates to the
languages in whose learned texts that script makes up at least ``SHARE`` of the letters; if no
language has it, the word says nothing.  A Viterbi pass over the words' scores, in which every
change of language costs ``SWITCH``, labels each word, so mixed texts fall into spans.  The
language of a text is the one with the most labelled letters (ties: the first in the order of
names), and ``score`` the share of the letters of words that say something labelled so.

At most ``MAX_PER_LANGUAGE`` documents a language are learned from, expected number, the
lowest by hash of the id; null languages and null texts are not learned from.  A null text or
one without a letter is ``und`` with score 0, so is any text when nothing was learned.  A text
of whose words none says anything gets the language with the most learned letters, score 0.
Whole texts are read; very long ones take memory in proportion to their words.  Repeated rows
get the same result each, further columns are carried, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import by_value, text_of

by_value(__name__)

UNKNOWN = "und"
SLOTS = 1 << 17
ORDERS = 4
ADDED = 0.1
SWITCH = 16.0
SHARE = 0.01
MAX_PER_LANGUAGE = 5_000
BATCH_WORDS = 1 << 19
_CACHED = 300_000

#: Starts of Unicode ranges and the script of each (fixed values; "" is every other letter).
SCRIPTS = (
    (0x0000, "Latin"), (0x0250, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, ""), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, ""), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""), (0x1780, "Khmer"), (0x1800, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x3040, "Kana"), (0x3100, ""),
    (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD800, ""), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, ""), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, ""),
    (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x32000, ""),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = tuple(sorted({n for _, n in SCRIPTS}))
_SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])



def _class(inside: Callable[[str], bool]) -> str:
    """The characters for which ``inside`` holds, as ranges of a regular expression."""
    on = np.array([inside(chr(c)) for c in range(0x110000)])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in edge.reshape(-1, 2).tolist())


#: A letter and the letters and marks behind it.
_LETTERS = re.compile(f"[{_class(str.isalpha)}][{_class(lambda c: c.isalpha() or unicodedata.category(c)[0] == 'M')}]*")


def scripts(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    first = np.array([ord(w[0]) for w in words], dtype=np.int64)
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, side="right") - 1]


def mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of all letter groups of the words, and of the words themselves."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    owner = np.zeros(len(text), dtype=np.int64)  # the word that begins with the border at or before a place
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner[begins[1:-1]] = 1
    owner = np.cumsum(owner)
    ends = begins[1:]  # the border behind each word
    place = np.arange(len(text))
    words_of, slots = [], []
    value = np.zeros(len(text), dtype=np.uint64)
    for order in range(1, ORDERS + 1):
        n = len(text) - order + 1
        if n <= 0:
            break
        value = value[:n] * np.uint64(0x100000001B3) + text[order - 1 :] + np.uint64(order)
        whole = place[:n] + order - 1 <= ends[owner[:n]]
        if order == 1:
            whole &= text != 2
        words_of.append(owner[:n][whole])
        slots.append(mixed(value[whole] + np.uint64(order << 56)))
    letters = np.where(text == 2, np.uint64(0), mixed(text + (place - begins[owner]).astype(np.uint64) * np.uint64(0x1000000)))
    words_of.append(np.arange(len(words)))
    slots.append(mixed(np.add.reduceat(letters, begins[:-1]) + np.uint64(9 << 56)))
    return np.concatenate(words_of), (np.concatenate(slots) % np.uint64(SLOTS)).astype(np.int64)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task by language and slot; place SLOTS + s counts the letters of script s."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        heard: dict[str, dict[str, int]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            own = heard.setdefault(lang, {})
            for w in _LETTERS.findall(text):
                own[w] = own.get(w, 0) + 1
        for lang, own in heard.items():
            if not own:
                continue
            seen = total.setdefault(lang, np.zeros(SLOTS + len(NAMES), dtype=np.int64))
            words, times = [w.lower() for w in own], np.fromiter(own.values(), np.int64, len(own))
            word, slot = grams(words)
            np.add.at(seen, slot, times[word])
            np.add.at(seen, SLOTS + scripts(words), times * np.fromiter(map(len, words), np.int64, len(words)))
    for lang, seen in total.items():
        on = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on)), pa.array(on), pa.array(seen[on])], ["lang", "slot", "n"])


def path(scores: np.ndarray, texts: list[int], switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; the words of the texts lie behind each other, ``texts`` has their numbers.

    All texts of the batch go forward one word at a time, the longer ones first, so that those
    still running are always the first rows.
    """
    sizes = np.array(texts, dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    running = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), side="left")
    best = np.zeros((len(sizes), scores.shape[1]))
    stay = np.zeros(scores.shape, dtype=bool)
    from_ = np.zeros(len(scores), dtype=np.int32)
    for t, n in enumerate(running.tolist()):
        at = begins[:n] + t
        now = best[:n]
        top = now.argmax(1)
        high = now[np.arange(n), top][:, None] - switch
        from_[at] = top
        stay[at] = now >= high
        best[:n] = np.maximum(now, high) + scores[at]
        best[:n] -= best[:n].max(1, keepdims=True)
    out = np.zeros(len(scores), dtype=np.int32)
    state = best.argmax(1)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = begins[:n] + t
        own = state[:n]
        out[at] = own
        state[:n] = np.where(stay[at, own], own, from_[at])
    return out


@dataclass(eq=False)
class LanguageModel:
    """Log shares by slot and language; ``allowed`` says which languages have a script."""

    names: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    allowed: np.ndarray | None = None
    commonest: str = UNKNOWN

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words: at most 0, the best candidate's is 0; all 0 if the word says nothing."""
        if not words:
            return np.zeros((0, len(self.names)))
        words = [w.lower() for w in words]
        word, slot = grams(words)
        out = np.stack([np.bincount(word, self.table[slot, k], len(words)) for k in range(len(self.names))], 1)
        able = self.allowed[scripts(words)]
        out[~able] = -np.inf
        out[~able.any(1)] = 0.0
        out -= out.max(1, keepdims=True)
        return np.maximum(out, -1e6)

    def label(self, texts: list[str | None], spans: bool) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans as (start, end, language) in code points) of every text."""
        known: dict[str, int] = {}
        scores = np.zeros((0, len(self.names)))
        group: list[list] = []
        size = 0
        for text in texts:
            found = list(_LETTERS.finditer(text or "")) if spans else _LETTERS.findall(text or "")
            if group and size + len(found) > BATCH_WORDS:
                scores = yield from self._labelled(group, spans, known, scores)
                group, size = [], 0
            group.append(found)
            size += len(found)
        if group:
            yield from self._labelled(group, spans, known, scores)

    def _labelled(self, group, spans, known, scores):
        if len(known) > _CACHED:
            known.clear()
            scores = scores[:0]
        plain = [[m.group() for m in g] if spans else g for g in group]
        ids, new = [], []
        for g in plain:
            for w in g:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    new.append(w)
                ids.append(k)
        scores = np.concatenate([scores, self.word_scores(new)])
        sizes = [len(g) for g in group]
        picked = np.array(ids, dtype=np.int64)
        own = scores[picked]
        langs = path(own, sizes)
        letters = np.fromiter((len(w) for g in plain for w in g), np.int64, len(ids))
        telling = own.min(1) < 0 if len(self.names) > 1 else np.ones(len(ids), dtype=bool)
        text_no = np.repeat(np.arange(len(group)), sizes)
        weight = np.zeros((len(group), len(self.names)))
        np.add.at(weight, (text_no, langs), letters * telling)
        total, top = weight.sum(1), weight.argmax(1)
        at = 0
        for i, g in enumerate(group):
            if not g:
                yield UNKNOWN, 0.0, []
            elif not total[i]:
                yield self.commonest, 0.0, []
            else:
                parts = []
                if spans:
                    mine = langs[at : at + len(g)]
                    cut = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), len(g)]
                    parts = [(g[a].start(), g[b - 1].end(), self.names[mine[a]]) for a, b in zip(cut, cut[1:], strict=False)]
                yield self.names[top[i]], float(weight[i, top[i]] / total[i]), parts
            at += len(g)
        return scores

    def label_column(self, text: Column, spans: bool = False) -> Column:
        """Struct of ``lang``, ``score`` and, if asked for, ``spans`` (start, end, lang)."""
        model = self

        @F.arrow_udf("struct<lang:string,score:double,spans:array<struct<start:bigint,end:bigint,lang:string>>>")
        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            part = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
            for batch in batches:
                rows = list(model.label(batch.to_pylist(), spans))
                yield pa.StructArray.from_arrays([
                    pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in r[2]] for r in rows], pa.list_(part)),
                ], ["lang", "score", "spans"])

        if not self.names:
            return F.struct(
                F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"),
                F.array().cast("array<struct<start:bigint,end:bigint,lang:string>>").alias("spans"))
        return find(text)

    def apply(self, docs: DataFrame, text: str = "text", label: str = "language", spans: bool = True) -> DataFrame:
        """The documents with the struct ``label``."""
        own = [c for c in docs.columns if c != label]
        return docs.select(*own, self.label_column(text_of(text), spans).alias(label))


def learned_rows(docs: DataFrame, learn: Column, doc_id: str, lang: str, bound: int) -> DataFrame:
    """Ids and languages of a sample of about ``bound`` documents a language, the lowest by hash of the id."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("lang")).count().collect()
    few = {r["lang"]: bound / r["count"] for r in counts if r["count"] > bound}
    share = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)) / (1 << 30)
    for name, part in few.items():
        rows = rows.filter((F.col(lang) != name) | (share < part))
    return rows


def fit(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = MAX_PER_LANGUAGE
) -> LanguageModel:
    """Learn from the documents where ``learn`` holds."""
    rows = learned_rows(docs, learn, doc_id, lang, bound)
    texts = rows.filter(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = texts.mapInArrow(count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = sums.toArrow().combine_chunks()
    if not found.num_rows:
        return LanguageModel()
    coded = found.column("lang").combine_chunks().dictionary_encode()
    names, place = np.unique(np.array(coded.dictionary.to_pylist()), return_inverse=True)
    which = place[coded.indices.to_numpy()]
    counts = np.zeros((len(names), SLOTS + len(NAMES)))
    counts[which, found.column("slot").to_numpy()] = found.column("n").to_numpy()
    letters, held = counts[:, SLOTS:], counts[:, :SLOTS]
    shares = np.log((held + ADDED) / (held.sum(1, keepdims=True) + ADDED * SLOTS))
    allowed = letters / letters.sum(1, keepdims=True) >= SHARE
    return LanguageModel(
        [str(n) for n in names], np.ascontiguousarray(shares.T.astype(np.float32)), np.ascontiguousarray(allowed.T),
        str(names[letters.sum(1).argmax()]))
