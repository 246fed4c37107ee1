"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a text
is the sum over all ways to cut it into pieces of the product of their probabilities, which a forward
pass computes: what ends at a place is the sum over pieces that end there of what ended before them.
Pieces hold a word mark only at their start, so no piece crosses a word's start: a text's sum is the
product of its words' sums, and each distinct word needs one pass.

Piece probabilities come from expectation-maximisation over the words of a bounded sample of documents: the
expected counts of pieces over all segmentations, found by a forward and a backward pass, in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lasting, materialize, named, portions, slices, unused, worker

MARK = "▁"
#: Documents of a language that the model is fitted on, about; languages that a model may have. Rounds of the fit.
TRAIN_DOCS, MAX_LANGUAGES, EM_ROUNDS = 2_000, 200, 2
#: In the fit, and nowhere else, a longer word counts as several.
TRAIN_CHARS = 4_096
#: Added to every expected count.
SMOOTHING = 0.1
#: Characters of the words whose matches are held at once; longer words are taken in pieces of so many, with the sums carried on.
BATCH_CHARS = 1 << 16
#: Bytes of text that are judged at once, and of the table of words' sums that a task keeps, about.
SLICE_BYTES, KEPT_BYTES = 2 << 20, 32 << 20
#: Places after which sums are brought back to one, so that long words don't underflow.
SCALED = 8
UNKNOWN = "und"
#: Prediction needs a letter of any script.
LETTER = r"\p{L}"
BLANK = r"[\t-\r ]+"


class Pieces:
    """The usable pieces of a vocabulary and all their places in words."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        known = [p for p in known if MARK not in p[1:] and "\n" not in p]
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(known):
            self.automaton.add_word(piece, i << 8 | len(piece))
        self.automaton.make_automaton()
        self.longest = max(map(len, known), default=1)
        #: the last piece stands for any one character that no piece covers
        self.count = len(known) + 1

    def lattice(self, words: list[str]) -> Lattice:
        """All places of pieces in the words."""
        text = "".join(words)
        lengths = np.array([len(w) for w in words], np.int64)
        begins = np.cumsum(lengths) - lengths
        found = np.fromiter((e << 32 | v for e, v in self.automaton.iter(text)), np.int64)
        ends = (found >> 32) + 1
        which, starts = (found & 0xFFFFFFFF) >> 8, ends - (found & 0xFF)
        word = np.searchsorted(begins, starts, side="right") - 1
        inside = begins[word] + lengths[word] >= ends
        starts, ends, which, word = starts[inside], ends[inside], which[inside], word[inside]
        alone = np.ones(len(text), bool)
        alone[starts[ends - starts == 1]] = False
        rest = np.flatnonzero(alone)
        of_rest = np.searchsorted(begins, rest, side="right") - 1
        which = np.concatenate((which, np.full(len(rest), self.count - 1)))
        word = np.concatenate((word, of_rest))
        starts, ends = np.concatenate((starts, rest)), np.concatenate((ends, rest + 1))
        return Lattice(lengths, word, starts - begins[word], ends - begins[word], which)


@dataclass
class Lattice:
    """Pieces in words: the length of each word, and word, start, end and piece of every match."""

    lengths: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    which: np.ndarray

    def mirrored(self) -> Lattice:
        of = self.lengths[self.word]
        return Lattice(self.lengths, self.word, of - self.end, of - self.start, self.which)

    def nodes(self, word: np.ndarray, level: np.ndarray) -> np.ndarray:
        """A word of n characters has the nodes 0 to n; those of all words are numbered on."""
        return (np.cumsum(self.lengths + 1) - self.lengths - 1)[word] + level

    def sweep(self, probability: np.ndarray, longest: int, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all ways to each node, a column for each language, and the logarithm of what each was divided by.

        begun: the sums at the first nodes of the only word, where they are known already.
        """
        words, languages = len(self.lengths), probability.shape[1]
        base = np.cumsum(self.lengths + 1) - self.lengths - 1
        sums = np.zeros((int((self.lengths + 1).sum()), languages))
        scale, of_node = np.zeros((words, languages)), np.zeros_like(sums)
        sums[base] = 1.0
        known = 1
        if begun is not None:
            sums[: len(begun)], known = begun, len(begun)
        left, right = base[self.word] + self.start, base[self.word] + self.end
        order = np.lexsort((right, self.end))
        order = order[np.searchsorted(self.end[order], known) :]
        left, right, which, level = left[order], right[order], self.which[order], self.end[order]
        waves = np.flatnonzero(np.diff(level)) + 1
        for a, b in zip(np.concatenate(([0], waves)).tolist(), np.concatenate((waves, [len(level)])).tolist()):
            if a == b:
                continue
            heads = np.flatnonzero(np.concatenate(([True], right[a + 1 : b] != right[a : b - 1])))
            sums[right[a:b][heads]] = np.add.reduceat(sums[left[a:b]] * probability[which[a:b]], heads, axis=0)
            at = int(level[a])
            if at % SCALED == 0:
                # every later way starts from one of the last places, so only these are scaled
                some = np.flatnonzero(self.lengths > at)
                if len(some):
                    nodes = base[some][:, None] + np.arange(max(0, at - longest + 1), at + 1)
                    most = np.maximum(sums[nodes].max(axis=1), 1e-300)
                    sums[nodes] /= most[:, None]
                    scale[some] += np.log(most)
                    of_node[nodes] = scale[some][:, None]
        some = np.flatnonzero(self.lengths > SCALED)
        if len(some):
            tail = (self.lengths[some] - 1) // SCALED * SCALED + 1
            levels = np.minimum(tail[:, None] + np.arange(SCALED), self.lengths[some][:, None])
            of_node[base[some][:, None] + levels] = scale[some][:, None]
        return sums, of_node


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def forward(pieces: Pieces, words: list[str], probability: np.ndarray) -> np.ndarray:
    """log of the summed probability of each word, for every language (column of probability)."""
    out = np.zeros((len(words), probability.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= BATCH_CHARS]
    for some in portions(short, [len(words[i]) for i in short], BATCH_CHARS):
        lattice = pieces.lattice([words[i] for i in some])
        sums, scale = lattice.sweep(probability, pieces.longest)
        last = lattice.nodes(np.arange(len(some)), lattice.lengths)
        out[some] = _log(sums[last]) + scale[last]
    for i, word in enumerate(words):
        if len(word) > BATCH_CHARS:
            out[i] = _forward_long(pieces, word, probability)
    return out


def _forward_long(pieces: Pieces, word: str, probability: np.ndarray) -> np.ndarray:
    """As forward, for one word, part by part: the sums at the last places are carried on, no way is cut."""
    begun, total, at, back = np.ones((1, probability.shape[1])), np.zeros(probability.shape[1]), 0, 0
    while at < len(word):
        to = min(len(word), at + BATCH_CHARS)
        lattice = pieces.lattice([word[at - back : to]])
        sums, scale = lattice.sweep(probability, pieces.longest, begun)
        at, back = to, min(to, pieces.longest)
        begun, total = sums[-back - 1 :], total + scale[-1]
        # places that no way was taken to are never asked for again, and the others have the last one's scale
    return total + _log(begun[-1])


def expected(pieces: Pieces, words: list[str], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected counts of pieces over all segmentations of weighted words, for one language."""
    total = np.zeros(pieces.count)
    for some in portions(list(range(len(words))), [len(w) for w in words], BATCH_CHARS):
        ahead = pieces.lattice([words[i] for i in some])
        behind = ahead.mirrored()
        sums, scale = ahead.sweep(probability, pieces.longest)
        rest, rest_scale = behind.sweep(probability, pieces.longest)
        left, right = ahead.nodes(ahead.word, ahead.start), behind.nodes(behind.word, behind.start)
        last = ahead.nodes(np.arange(len(some)), ahead.lengths)
        whole = _log(sums[last, 0]) + scale[last, 0]
        share = _log(sums[left, 0]) + scale[left, 0] + _log(rest[right, 0]) + rest_scale[right, 0] + _log(probability[ahead.which, 0])
        total += np.bincount(ahead.which, np.exp(share - whole[ahead.word]) * weights[some][ahead.word], minlength=pieces.count)
    return total


@lasting
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Distinct words, and where each text's words begin."""
    lists = pc.split_pattern_regex(texts.cast(pa.large_string()).fill_null(""), BLANK)
    offsets, flat = lists.offsets.to_numpy(), lists.values
    some = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return flat.filter(some).dictionary_encode(), counts[offsets]


@dataclass
class LanguageModel:
    """Piece probabilities (pieces x languages) over a vocabulary file."""

    languages: list[str]
    probability: np.ndarray
    path: str

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores whole texts and keeps a bounded table of words' sums."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, _pieces(model.path)
        self._empty()

    def _empty(self) -> None:
        self.kept: dict[str, int] = {}
        self.values = np.zeros((1_024, len(self.model.languages)))
        self.used = 0

    def word_scores(self, words: list[str]) -> np.ndarray:
        if self.used > KEPT_BYTES:
            self._empty()
        # shortest first: words of like length are taken together
        missing = sorted((w for w in words if w not in self.kept), key=len)
        if missing:
            had, have = len(self.kept), len(self.kept) + len(missing)
            if have > len(self.values):
                self.values = np.concatenate((self.values[:had], np.zeros((max(have, had + had // 2) - had, self.values.shape[1]))))
            self.values[had:have] = forward(self.pieces, [MARK + w for w in missing], self.model.probability)
            self.kept.update(zip(missing, range(had, have)))
            self.used += sum(map(len, missing)) + len(missing) * (150 + 8 * self.values.shape[1])
        return self.values[np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its share of the probability."""
        n, languages = len(texts), self.model.languages
        coded, offsets = _words(texts)
        sums = np.zeros((n, max(1, len(languages))))
        if languages and len(coded):
            scores, counted = self.word_scores(coded.dictionary.to_pylist()), coded.indices.to_numpy()
            full = np.flatnonzero(np.diff(offsets))
            for k in range(len(languages)):
                sums[full, k] = np.add.reduceat(scores[counted, k], offsets[:-1][full])
        lettered = pc.match_substring_regex(texts.cast(pa.large_string()).fill_null(""), LETTER).to_numpy(zero_copy_only=False)
        known = lettered & bool(languages)
        shares = np.exp(sums - sums.max(axis=1, keepdims=True))
        best = sums.argmax(axis=1)
        score = np.where(known, 1.0 / shares.sum(axis=1), 0.0)
        return [languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], score


def fit(
    docs: DataFrame, path: str, where: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS
) -> LanguageModel:
    """Fit on about train_docs documents of each language, taken by a hash of their ids.

    where: which rows may be learned from. Rows without text or lang are never. Of the sample every word counts, and
    stays on the executors: what reaches the driver in a round is a number for each piece and language. Without rows to
    learn from the model has no language. More than MAX_LANGUAGES languages are refused.
    """
    rows = docs.filter(named(lang).isNotNull() & named(text).isNotNull())
    rows = rows if where is None else rows.filter(where)
    rows = rows.select(named(doc_id).cast("string").alias("id"), named(lang).cast("string").alias("lang"), named(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    pieces = _pieces(path)
    if not languages:
        return LanguageModel([], np.zeros((pieces.count, 0)), path)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(train_docs / n))])
    place = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1_000_000)) / 1_000_000
    sample = rows.filter(place < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker(_pieces):
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    coded, offsets = _words(part.column("text"))
                    langs = part.column("lang").dictionary_encode()
                    of = np.repeat(langs.indices.to_numpy(), np.diff(offsets))
                    key, n = np.unique(of.astype(np.int64) << 32 | coded.indices.to_numpy(), return_counts=True)
                    columns = [langs.dictionary.take(pa.array(key >> 32)), coded.dictionary.take(pa.array(key & 0xFFFFFFFF)).cast(pa.string()), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")
    probability = np.full((pieces.count, len(languages)), 1.0 / pieces.count)
    for _ in range(EM_ROUNDS):
        found = _expectation(counts, LanguageModel(languages, probability, path)) + SMOOTHING
        probability = found / found.sum(axis=0)
    return LanguageModel(languages, probability, path)


def _expectation(counts: DataFrame, model: LanguageModel) -> np.ndarray:
    """Expected counts of pieces in each language's words: added up by task, then over all tasks."""
    context = counts.sparkSession.sparkContext
    shared, path, languages = context.broadcast(model.probability), model.path, model.languages

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, probability = _pieces(path), shared.value
        total = np.zeros_like(probability)
        for batch in batches:
            for part in slices(batch, "word", SLICE_BYTES // 4):
                for k, language in enumerate(languages):
                    own = part.filter(pc.equal(part.column("lang"), language))
                    cut = [(MARK + w, n) for w, n in zip(own.column("word").to_pylist(), own.column("n").to_pylist())]
                    cut = sorted(((w[a : a + TRAIN_CHARS], n) for w, n in cut for a in range(0, len(w), TRAIN_CHARS)), key=lambda x: (len(x[0]), x))
                    total[:, k] += expected(pieces, [w for w, _ in cut], np.array([n for _, n in cut], float), probability[:, k : k + 1])
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(k, pa.int32()), pa.array(total[piece, k])], ["piece", "k", "n"])

    sums = counts.mapInArrow(expect, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    found = np.zeros_like(model.probability)
    found[sums.column("piece").to_numpy(), sums.column("k").to_numpy()] = sums.column("n").to_numpy()
    return found


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, lang_pred, score for every row of docs; only the text is looked at.

    lang_pred is a language of the model, or ``und`` with score 0 where the text is null or has no
    letter, or the model has no language. score is the language's share of the text's probability, from 0
    to 1. Ties go to the language that sorts first. Repeated rows are judged each; an empty table gives
    no rows. Words of any length are scored whole. Other columns are not read, whatever their names. The model is
    bounded: pieces of the vocabulary times languages.
    """
    judged = docs.select(named(doc_id).alias("doc_id"), _judge(docs, model)(named(text)).alias("judged"))
    return judged.select("doc_id", "judged.lang_pred", "judged.score")


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of least or more.

    Texts that are null or have no letter go, and so does every row if the model has no language. Repeated rows are judged
    each; an empty table gives no rows. Columns may have any names. Texts are only read: rows stay in Spark.
    """
    mark = unused(docs, "judged")
    kept = docs.withColumn(mark, _judge(docs, model)(named(text)))
    return kept.filter((F.col(mark)["lang_pred"] != UNKNOWN) & (F.col(mark)["score"] >= least)).select(*map(named, docs.columns))


def _judge(docs: DataFrame, model: LanguageModel):
    """The column function from texts to lang_pred and score. Rows don't pass through Python, only texts do."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.probability))
    path = model.path

    @F.arrow_udf("lang_pred string, score double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with worker(_pieces):
            scorer = Scorer(LanguageModel(*shared.value, path))
            for texts in batches:
                found, scores = [], []
                for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE_BYTES):
                    langs, score = scorer.predict(part.column("text"))
                    found += langs
                    scores.append(score)
                yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["lang_pred", "score"])
            del scorer

    return judge


def held_out(doc_id: Column) -> Column:
    """The third of documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
