"""Quality rules: distribution divergence from language references.

Every text gets two histograms: character classes and common words. Its
language's reference is the mean histogram of that language's own documents
(those that pass the base rules), so the references follow the corpus. A text is
rejected when the Jensen-Shannon distance (base 2, the square root, 0 to 1) of
either histogram from the reference is over its limit. Two guards keep short
texts safe: below ``min_words`` no distance is taken, and above it the limit
shrinks with the square root of the number of words.

Defined results: a null text counts as empty (no words, base_failed, not kept);
a null language is the language ``und``; repeated rows are judged alike, each
by itself; an empty table gives an empty result; a text is measured whole in one task, with some 40
bytes of memory for each of its bytes. A label that only few or only junk documents have is its own reference,
so the distances say nothing against them and the base rules alone decide; other columns pass through, but
for one that has the name of the new column, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import text_hash as H

# Characters counted as symbols by the base rules.
SYMBOLS = "#*$%&|<>"

# Frequent function words, the bins of the word histogram.
COMMON_WORDS = {
    "en": "the of and to in a is that it was for on are as with be at by this from have or an they which you had not but what".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son elle ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
BINS = sorted({w for words in COMMON_WORDS.values() for w in words})

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A limit is floor + slack / sqrt(n_words): short texts have noisier histograms.
CHAR_LIMIT = (0.12, 1.0)
WORD_LIMIT = (0.17, 1.8)
MAX_LANGUAGES = 10_000
_UNIT = 1 << 40

_CLASSES = 9  # vowels, consonants, capitals, digits, spaces, line ends and tabs, sentence marks, other ASCII, letters beyond ASCII


def _class_table() -> np.ndarray:
    table = np.full(256, 7, np.int64)
    for k, chars in enumerate(("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\r\x0b\x0c", ".,;:!?'\"()-")):
        table[list(chars.encode())] = k
    table[0xC0:] = 8
    table[0x80:0xC0] = _CLASSES  # continuation bytes: dropped
    return table


_CLASS = _class_table()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(hashes: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more in it."""
    keys, at = H.grams(hashes, text, 3)
    keys = H.mix(keys ^ (text[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys) + 1, bool)
    twice[1:-1] |= same
    twice[:-2] |= same
    found = at[order[twice[: len(keys)]]] if len(keys) > 1 else at[:0]
    marked = np.zeros(len(hashes), bool)
    for k in range(3):
        marked[found + k] = True
    return np.bincount(text[marked], minlength=n_texts)


def _duplicate_lines(texts: H.Texts) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    raw, offsets = texts.data.tobytes(), texts.offsets
    for i in np.flatnonzero(texts.per_text(texts.data == 10)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts and both histograms (rows: texts) of a column of texts."""
    texts = H.texts_of(column)
    words = H.words_of(texts)
    n = len(texts)
    hashes = H.Hasher(texts.data).ranges(words.start, words.end)
    in_word = ~H.IS_SPACE[texts.data] & ((texts.data & 0xC0) != 0x80)
    of_text = np.repeat(np.arange(n), np.diff(texts.offsets))
    classes = np.bincount(of_text * (_CLASSES + 1) + _CLASS[texts.data], minlength=n * (_CLASSES + 1)).reshape(n, -1)[:, :_CLASSES]

    bins = H.hash_strings(BINS)
    order = np.argsort(bins)
    place = np.searchsorted(bins[order], hashes).clip(max=len(bins) - 1)
    which = np.where(bins[order][place] == hashes, order[place], len(BINS))
    common = np.bincount(words.text * (len(BINS) + 1) + which, minlength=n * (len(BINS) + 1)).reshape(n, -1)
    return {
        "n_words": np.diff(words.first),
        "word_chars": texts.per_text(in_word),
        "n_symbols": texts.per_text(_SYMBOL[texts.data]),
        "n_dup_lines": _duplicate_lines(texts),
        "n_repeat_words": _repeated_words(hashes, words.text, n),
        "chars": classes,
        "common": common,
    }


def base_failed(m: dict[str, np.ndarray], min_words: int = MIN_WORDS, max_repeat_percent: float = MAX_REPEAT_PERCENT) -> np.ndarray:
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the rows of two arrays of shares."""
    m = (p + q) / 2

    def half(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)

    return np.sqrt(np.clip((half(p) + half(q)) / 2, 0, 1))


def _langs(batch: pa.RecordBatch, lang_col: str) -> np.ndarray:
    return np.array([x if x is not None else "und" for x in batch.column(lang_col).to_pylist()], object)


def fit_references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS) -> dict[str, tuple[list[float], list[float]]]:
    """language -> (shares of character classes, shares of common words).

    Each partition sends one row of sums per language, and the driver gets one
    row per language (at most ``MAX_LANGUAGES``, or this raises ValueError). Shares are
    summed as whole numbers of 2**-40, so the sums don't hang on how rows are dealt.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in (s for b in batches for s in H.slices(b, text_col)):
            m = measures(batch.column(text_col))
            good = ~base_failed(m, min_words)
            langs = _langs(batch, lang_col)
            chars, common = _shares(m["chars"]), _shares(m["common"])
            for lang in set(langs[good]):
                at = good & (langs == lang)
                got = sums.setdefault(lang, [0, 0, 0])
                got[0] += int(at.sum())
                got[1] = got[1] + np.rint(chars[at] * _UNIT).astype(np.int64).sum(axis=0)
                got[2] = got[2] + np.rint(common[at] * _UNIT).astype(np.int64).sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "n": [v[0] for v in sums.values()], "chars": [v[1].tolist() for v in sums.values()], "common": [v[2].tolist() for v in sums.values()]})

    sums = docs.select(F.col(text_col), F.col(lang_col)).mapInArrow(partial, "lang string, n long, chars array<long>, common array<long>")
    total = [F.sum("n").alias("n")]
    for name, size in (("chars", _CLASSES), ("common", len(BINS) + 1)):
        total.append(F.array(*[F.sum(F.col(name)[i].cast("decimal(38,0)")) for i in range(size)]).alias(name))
    rows = sums.groupBy("lang").agg(*total).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: ([int(x) / (_UNIT * r["n"]) for x in r["chars"]], [int(x) / (_UNIT * r["n"]) for x in r["common"]]) for r in rows}


def score(
    docs: DataFrame,
    references: dict[str, tuple[list[float], list[float]]] | None = None,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = MIN_WORDS,
    max_repeat_percent: float = MAX_REPEAT_PERCENT,
    char_limit: tuple[float, float] = CHAR_LIMIT,
    word_limit: tuple[float, float] = WORD_LIMIT,
    into: str = "quality",
) -> DataFrame:
    """``docs`` with the struct column ``into``: the base counts, base_failed,
    char_distance, word_distance (null below ``min_words`` or without a
    reference) and kept. Rows stay where they are: nothing is shuffled."""
    references = fit_references(docs, text_col=text_col, lang_col=lang_col, min_words=min_words) if references is None else references
    docs = docs.drop(into)
    fields = [(c, pa.int64()) for c in BASE_COLUMNS] + [("base_failed", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("kept", pa.bool_())]
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType([T.StructField(c, {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType()}.get(t, T.DoubleType())) for c, t in fields]))])
    names = list(references)
    row_of = {x: i for i, x in enumerate(names)}
    chars = np.array([references[x][0] for x in names]).reshape(-1, _CLASSES)
    common = np.array([references[x][1] for x in names]).reshape(-1, len(BINS) + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in H.slices(b, text_col)):
            m = measures(batch.column(text_col))
            failed = base_failed(m, min_words, max_repeat_percent)
            row = np.array([row_of.get(x, -1) for x in _langs(batch, lang_col)])
            known = (row >= 0) & (m["n_words"] >= min_words)
            far = {}
            for name, ref in (("char_distance", chars), ("word_distance", common)):
                far[name] = np.zeros(len(row))
                if known.any():
                    far[name][known] = js_distance(_shares(m["chars" if ref is chars else "common"][known]), ref[row[known]])
            root = np.sqrt(np.maximum(m["n_words"], 1))
            kept = ~failed
            for name, (floor, slack) in (("char_distance", char_limit), ("word_distance", word_limit)):
                kept &= far[name] <= floor + slack / root
            out = {**{c: m[c] for c in BASE_COLUMNS}, "base_failed": failed, **far, "kept": kept}
            arrays = [pa.array(out[c], t, mask=~known if c in far else None) for c, t in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, [c for c, _ in fields])], [*batch.schema.names, into])

    return docs.mapInArrow(judge, schema)
