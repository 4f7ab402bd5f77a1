"""Quality rules: word, symbol and repetition counts, then the perplexity of modified Kneser-Ney n-gram models by language.

The models are over the bytes of a document's words with one space between, so n-grams cross word boundaries, with marks
at a document's start and end. Spark counts the n-grams of ORDER of the documents that pass the base rules: tasks count
within Arrow batches, counts are summed by language and n-gram. Modified Kneser-Ney (three discounts an order,
continuation counts below the highest order, interpolated) gives each seen n-gram its log probability; a model is kept as
sorted arrays of n-grams with parallel values. Models of MAX_GRAMS n-grams of ORDER together at most are collected and broadcast.

Beyond that no n-gram is left out: what is broadcast are the probabilities, under the models of all n-grams, of the most frequent
ones, MAX_GRAMS at most and an equal share for each language. The scan of the documents passes on the sums of their chunks over
these and each chunk's other n-grams, whose probabilities are joined to them. Probabilities are worked out in buckets of one language
and the two bytes before the predicted one: all that an n-gram of order 3 or more depends on is in its bucket, but for the
discounts, which are a few sums, and the orders 1 and 2 (up to 65536 n-grams a language), which are broadcast. Such a pair of
bytes has 2^24 n-grams at most, however large the table; a bucket has some PART in the mean.

A document has two scores, by its language's model of order SHORTER and by that of order ORDER. It is cut into chunks of CHUNK
predicted bytes; a score is the mean negative log probability a byte of its middle chunk, half of the bytes being in chunks
that the model finds no less likely. So a passage in another language, a key or a link does not outweigh the prose around it. Each language has bands around the medians of its own documents' scores, WIDTH times the median absolute
deviation and never narrower than FLOOR; means of few words scatter more, so a document of n words has sqrt(1 + SHORT / n)
times that. Outside the band of the shorter order are texts unlike the language or unlike prose (broken encodings, symbol
noise); above that of the longer one are texts whose words do not follow each other as the language's do (word salad).
Below the latter is text that many documents share, which is for the dedup stages and no ground for rejection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, lean, pieces, small_batches
from .kernels import WHITE, Rolling, mix, multiset, per_doc, windows, words

START, END = 2, 3
ORDER, SHORTER, GRAM_BITS = 5, 3, 40
MAX_GRAMS, HELD = 1 << 21, 1 << 20  # broadcast, of all models together; of a task before it sums them up
PIECE = 1 << 18  # bytes of text that are counted or scored together; workers run beside each other and the executor's heap
PART = 1 << 18  # n-grams of a bucket where the models are beyond MAX_GRAMS
MIN_WORDS, MAX_REPEAT = 50, 50
CHUNK = 256  # predicted bytes that are scored together
WIDTH, FLOOR, SHORT, STEP = 5.0, 0.05, 50, 1000  # chosen on half of the labels; the README has the rates; scores are rounded to 1 / STEP

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(data, start, end, order):
    """Codes of the n-grams of symbol runs, padded with START and one END, and the run of each."""
    size = end - start
    run = np.repeat(np.arange(len(size)), size + 1)
    first = np.cumsum(size + 1) - (size + 1)
    k = np.arange(len(run)) - first[run]  # 0..size: the symbol that is predicted
    at = start[run] + k
    padded = np.r_[data, np.zeros(1, np.uint8)]
    code = np.where(k < size[run], padded[np.minimum(at, len(data))], END).astype(np.int64)
    for j in range(1, order):
        code |= np.where(k >= j, padded[np.maximum(at - j, 0)], START).astype(np.int64) << 8 * j
    return code, run


def _trigrams(data, start, end):
    return _grams(data, start, end, 3)


def _symbols(data, offs, start, end, doc):
    """n-gram codes of documents as their words with one space between, and the document of each. No words, no codes."""
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    flat = np.where(WHITE[data], np.uint8(32), data)
    held = ~WHITE[data]
    held[start[inner] - 1] = True
    at = np.r_[0, np.cumsum(held)][offs]
    full = np.flatnonzero(at[1:] > at[:-1])
    code, run = _grams(flat[held], at[full], at[full + 1], ORDER)
    return code, full[run]


def _languages(batch, name, index: dict) -> np.ndarray:
    """Numbers of the rows' languages; `index` grows by those not met before."""
    col = batch.column(batch.schema.get_field_index(name))
    return np.fromiter((index.setdefault(x, len(index)) for x in col.to_pylist()), np.int64, len(col))


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram long, n long): n-grams of the documents that pass the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict = {}
        keys, counts, size = [], [], 0

        def merged():
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)

        def rows(k, n):
            names = pa.array(list(index), pa.string()).take(pa.array(k >> GRAM_BITS))
            return pa.RecordBatch.from_arrays([names, pa.array(k & (1 << GRAM_BITS) - 1), pa.array(n)], ["lang", "gram", "n"])

        for batch, data, offs in pieces(batches, limit=PIECE):
            which = _languages(batch, "lang", index)
            a, b, doc = words(data, offs)
            if not len(a):
                continue
            n_words = np.bincount(doc, minlength=len(offs) - 1)
            good = (n_words >= MIN_WORDS) & (100 * _repeats(Rolling(data).of(a, b), doc, len(offs) - 1) <= MAX_REPEAT * n_words)
            code, of = _symbols(data, offs, a, b, doc)
            k, n = np.unique(code[good[of]] | which[of[good[of]]] << GRAM_BITS, return_counts=True)
            keys, counts, size = [*keys, k], [*counts, n], size + len(k)
            if size > HELD:
                k, n = merged()
                if len(k) > HELD // 2:
                    yield rows(k, n)
                    keys, counts, size = [], [], 0
                else:
                    keys, counts, size = [k], [n], len(k)
        if keys:
            yield rows(*merged())

    src = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return src.mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").cast("long").alias("n"))


class KneserNey:
    """Interpolated modified Kneser-Ney over n-gram codes (a byte a symbol, the predicted one lowest), as sorted arrays for each order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int = 3):
        codes, c = self._shorter(grams, counts, order, 1)
        d, total = self._discounts(c[0]), max(1.0, c[0].sum())
        self.uni = np.full(256, (self._off(c[0], d).sum() / total if len(c[0]) else 1.0) / 257)
        self.uni[codes[0]] += np.maximum(c[0] - self._off(c[0], d), 0) / total
        self.levels = []
        self._longer(codes, c, self.uni[codes[0]], [self._discounts(x) for x in c], 1)

    @classmethod
    def bucket(cls, below: KneserNey, grams: np.ndarray, counts: np.ndarray, order: int, discounts: dict[int, list[float]]) -> KneserNey:
        """The model as far as it bears on n-grams of the buckets that `grams` are: its orders 1 and 2 are those of `below`, the
        discounts of orders 3 on are the whole model's."""
        out = cls.__new__(cls)
        out.uni, out.levels = below.uni, list(below.levels)
        codes, c = out._shorter(grams, counts, order, 3)
        pairs = np.unique(codes[0] & 0xFFFF)
        out._longer([pairs, *codes], [None, *c], below.pairs[np.searchsorted(below.levels[0][0], pairs)], [None, *(discounts[k] for k in range(3, order + 1))], 3 - 1)
        return out

    @staticmethod
    def _shorter(grams, counts, order, least):
        """Sorted codes and counts of the orders from `least` to `order`."""
        o = np.argsort(grams)
        codes, c = [grams[o].astype(np.int64)], [counts[o].astype(np.float64)]
        for k in range(order - 1, least - 1, -1):  # in how many contexts each shorter n-gram was seen
            x, n = np.unique(codes[0] & (1 << 8 * k) - 1, return_counts=True)
            codes, c = [x, *codes], [n.astype(np.float64), *c]
        return codes, c

    def _longer(self, codes, c, lower, discounts, least):
        """Levels above codes[0], the n-grams of order `least`, whose probabilities are `lower`."""
        for i in range(1, len(codes)):
            shorter = lower[np.searchsorted(codes[i - 1], codes[i] & (1 << 8 * (least + i - 1)) - 1)]
            lower, ctx, back = self._order(codes[i], c[i], shorter, discounts[i])
            self.levels.append((codes[i], np.log(lower), ctx, np.log(back)))
            if least + i == 2:
                self.pairs = lower

    @classmethod
    def _discounts(cls, c):
        return cls._discounts_of([float((c == k).sum()) for k in (1, 2, 3, 4)])

    @staticmethod
    def _discounts_of(n):
        """From the numbers of n-grams with counts of 1 to 4."""
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) * 0.5 for k in range(3)]
        return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]

    @staticmethod
    def _off(c, d):
        return np.where(c < 1.5, d[0], np.where(c < 2.5, d[1], d[2]))

    def _order(self, codes, c, lower, d):
        """Probabilities of the codes, whose high part is the context, and each context's weight for the order below."""
        ctx, at = np.unique(codes >> 8, return_inverse=True)
        total, kept = np.bincount(at, weights=c), np.bincount(at, weights=self._off(c, d))
        back = np.minimum(kept / total, 1.0)
        return np.maximum(c - self._off(c, d), 0) / total[at] + back[at] * lower, ctx, back

    @staticmethod
    def _find(keys, values, codes):
        if not len(keys):
            return np.zeros(len(codes)), np.zeros(len(codes), bool)
        i = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        hit = keys[i] == codes
        return np.where(hit, values[i], 0.0), hit

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(len(self.levels), 0, -1):
            keys, p, ctx, back = self.levels[k - 1]
            part = codes[todo] & (1 << 8 * (k + 1)) - 1
            found, hit = self._find(keys, p, part)
            out[todo[hit]] += found[hit]
            todo, part = todo[~hit], part[~hit]
            out[todo] += self._find(ctx, back, part >> 8)[0]
        out[todo] += np.log(self.uni[codes[todo] & 0xFF])
        return out


class Frequent:
    """Log probabilities of the most frequent n-grams of a model, which are `levels`' only level."""

    def __init__(self, grams: np.ndarray, log_p: np.ndarray):
        o = np.argsort(grams)
        self.levels = [(grams[o], log_p[o])]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities, 0 where the n-gram is not among them; and whether it is."""
        return KneserNey._find(*self.levels[0], codes)


class Cut(dict):
    """Pairs of Frequent by language, for models beyond what is broadcast; `ask` gives the log probabilities of other n-grams."""

    ask: Callable[[DataFrame], DataFrame]


def _repeats(h, doc, n):
    """Words of each document in windows of three that occur again in it."""
    cover = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 3:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        w, wdoc = windows(h, doc, 3, False)
        o = np.lexsort((w, wdoc))
        same = (w[o][1:] == w[o][:-1]) & (wdoc[o][1:] == wdoc[o][:-1])
        again = np.zeros(len(w), bool)
        again[o[1:][same]] = True
        again[o[:-1][same]] = True
        np.add.at(cover, at[again], 1)
        np.subtract.at(cover, np.minimum(at[again] + 3, len(h)), 1)
    return np.bincount(doc, weights=np.cumsum(cover)[:-1] > 0, minlength=n).astype(np.int64)


Models = list[tuple[KneserNey, KneserNey]] | list[tuple[Frequent, Frequent]]


def measure(data: np.ndarray, offs: np.ndarray, which: np.ndarray, models: Models) -> dict[str, np.ndarray]:
    """The counts of the contract for each document of a piece, and its scores by the models of its language `which`, over
    `symbols` predicted bytes; no symbols where that is beyond the models.

    Where the models are Frequent ones, also `chunks` (document, bytes, sums of both models over what they have) and `rest`
    (document, number of the chunk in it, n-gram and how often it occurs there) of the n-grams that they don't have."""
    n = len(offs) - 1
    a, b, doc = words(data, offs)
    h = Rolling(data).of(a, b)
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = per_doc(~WHITE[data] & ((data & 0xC0) != 0x80), offs)
    out["n_symbols"] = per_doc(_SYMBOL[data], offs)

    # lines with a word
    breaks = np.flatnonzero(data == 10)
    la = np.sort(np.r_[offs[:-1], breaks + 1])
    ldoc = np.sort(np.r_[np.arange(n), np.searchsorted(offs, breaks, "right") - 1])
    lb = np.r_[la[1:], len(data)] - 1
    lb = np.maximum(np.where(ldoc != np.r_[ldoc[1:], n], offs[ldoc + 1], lb), la)
    solid = np.r_[0, np.cumsum(~WHITE[data])]
    full = solid[lb] > solid[la]
    la, lb, ldoc = la[full], lb[full], ldoc[full]
    _, first, _ = multiset(Rolling(data).of(la, lb), ldoc)
    out["n_dup_lines"] = np.bincount(ldoc, minlength=n) - np.bincount(first, minlength=n)

    out["n_repeat_words"] = _repeats(h, doc, n)
    code, of = _symbols(data, offs, a, b, doc)
    known, back = np.unique(code | which[of] << GRAM_BITS, return_inverse=True)
    cuts = np.searchsorted(known >> GRAM_BITS, np.arange(len(models) + 1))
    nll, missed = np.zeros((2, len(known))), np.zeros(len(known), bool)
    for (shorter, longer), x, y in zip(models, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = known[x:y] & (1 << GRAM_BITS) - 1
        if isinstance(longer, Frequent):
            found, hit = longer.find(part)
            nll[1, x:y], missed[x:y] = -found, ~hit
            nll[0, x:y] = np.where(hit, -shorter.find(part & (1 << 8 * SHORTER) - 1)[0], 0.0)
            continue
        nll[1, x:y] = -longer.log_p(part)
        part, again = np.unique(part & (1 << 8 * SHORTER) - 1, return_inverse=True)
        nll[0, x:y] = -shorter.log_p(part)[again]
    if len(models) and isinstance(models[0][1], Frequent):
        first, doc, weight = _chunks(of, n)
        out["chunks"] = (doc, weight, *(np.add.reduceat(x[back], first) if len(first) else np.zeros(0) for x in nll))
        at = np.flatnonzero(missed[back])
        chunk = np.searchsorted(first, at, "right") - 1
        pairs, times = np.unique(chunk * max(1, len(known)) + back[at], return_counts=True)
        chunk, gram = pairs // max(1, len(known)), known[pairs % max(1, len(known))] & (1 << GRAM_BITS) - 1
        out["rest"] = (doc[chunk], chunk - np.searchsorted(doc, doc[chunk]), gram, times)
    out["symbols"] = np.bincount(of, minlength=n) * (which < len(models))
    out["score"] = np.stack([_middle(x[back], of, n) for x in nll])
    return out


def _middle(nll, of, n):
    """For each document the mean of its middle chunk: CHUNK predicted bytes each, ordered by their means, weighted by their
    bytes. 0 without any."""
    if not len(of):
        return np.zeros(n)
    new, doc, weight = _chunks(of, n)
    return _middle_of(doc, weight, np.add.reduceat(nll, new) / weight, n)


def _chunks(of, n):
    """First symbol, document and number of symbols of the chunks."""
    size = np.bincount(of, minlength=n)
    place = np.arange(len(of)) - (np.cumsum(size) - size)[of]
    new = np.flatnonzero(place % CHUNK == 0)
    return new, of[new], np.diff(np.r_[new, len(of)])


def _middle_of(doc, weight, mean, n):
    """_middle of chunks by their documents, in order, with their bytes and means."""
    out = np.zeros(n)
    size = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
    o = np.lexsort((mean, doc))
    doc, weight, mean = doc[o], weight[o], mean[o]
    upto = np.cumsum(weight) - (np.cumsum(size) - size)[doc]
    half = np.flatnonzero(2 * upto >= size[doc])
    first = half[np.r_[True, doc[half][1:] != doc[half][:-1]]]
    out[doc[first]] = mean[first]
    return out


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


SCORES = ["_q_score", "_q_score_long"]
#: Of rows with n-grams beyond Frequent models: bytes and sums of their chunks, and chunk, n-gram and number of each such n-gram.
CHUNKS = {"_q_bytes": "array<int>", "_q_sum": "array<double>", "_q_sum_long": "array<double>"}
REST = {"_q_at": "array<int>", "_q_gram": "array<long>", "_q_times": "array<int>"}


def score(docs: DataFrame, models: dict[str | None, tuple[KneserNey, KneserNey]], keep: list[str], lang: str = "lang", text: str = "text") -> DataFrame:
    """`row` (columns `keep` of docs), `lang`, the counts and both scores (mean -log p a byte in thousandths, null without words or
    model), in one scan. A text that is in `keep` is sent once. By Cut models, rows with n-grams beyond them get no score yet; all
    have `_q_id`, and those CHUNKS and REST, which are null in others."""
    cut = isinstance(models, Cut)
    held = docs.sparkSession.sparkContext.broadcast(dict(models))
    own = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    src = docs.select(own.alias("row"), F.col(lang).cast("string").alias("lang"), *([] if text in keep else [F.col(text).alias("text")]), *([F.monotonically_increasing_id().alias("_q_id")] if cut else []))
    fields = [*(T.StructField(f"_q_{k}", T.LongType()) for k in FIELDS), *(T.StructField(k, T.IntegerType()) for k in SCORES)]
    if cut:
        fields += [T.StructField("_q_id", T.LongType()), *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in (CHUNKS | REST).items())).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_text():
            for b in batches:
                t = b.column(0).field(text) if text in keep else b.column(2)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), t, b.column(b.num_columns - 1)], ["row", "lang", "text", "id"])

        own, index = list(held.value.values()), {x: i for i, x in enumerate(held.value)}
        for batch, data, offs in pieces(with_text(), limit=PIECE):
            m = measure(data, offs, _languages(batch, "lang", index), own)
            s = np.rint(STEP * m["score"]).astype(np.int32)
            none = m["symbols"] == 0
            more = []
            if cut:
                (cdoc, *chunks), (rdoc, *rest) = m["chunks"], m["rest"]
                full = np.isin(np.arange(len(offs) - 1), rdoc)
                none = none | full
                late = full[cdoc]
                more = [batch.column(3), *(_lists(cdoc[late], x[late], full) for x in chunks), *(_lists(rdoc, x, full) for x in rest)]
                more = [x.cast(t) for x, t in zip(more, [pa.int64(), *(pa.list_(t()) for t in (pa.int32, pa.float64, pa.float64, pa.int32, pa.int64, pa.int32))], strict=True)]
            cols = [pa.array(m[k].astype(np.int64)) for k in FIELDS] + [pa.array(x, mask=none) for x in s] + more
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["row", "lang", *(f.name for f in fields)])

    return src.mapInArrow(lean(run), T.StructType([src.schema["row"], src.schema["lang"], *fields]))


def _lists(doc, values, full):
    """The values of each document, which are in order, as a list; null where it is not `full`."""
    ends = np.cumsum(np.bincount(doc, minlength=len(full)))
    offs = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[~full, False])
    return pa.ListArray.from_arrays(offs, pa.array(values))


def late_scores(first: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_q_id, both scores) of the rows of `score` that have n-grams beyond its models, whose log probabilities `ask` gives."""
    waiting = first.where(F.col("_q_at").isNotNull())
    each = waiting.select("_q_id", "lang", F.explode(F.arrays_zip(*REST)).alias("x")).select("_q_id", "lang", *[F.col(f"x.{c}").alias(c) for c in REST])
    got = ask(each.select("lang", F.col("_q_gram").alias("gram")).distinct()).withColumnRenamed("lang", "_l")
    both = each.join(got, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("_q_gram") == F.col("gram")))
    sums = both.groupBy("_q_id", "_q_at").agg(*(-F.sum(F.col("_q_times") * F.col(c)) for c in ("short", "long"))).toDF("_q_id", "at", "short", "long")
    lists = sums.groupBy("_q_id").agg(F.collect_list(F.struct("at", "short", "long")).alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = lambda x: pc.list_parent_indices(x).to_numpy()
            of, bytes_ = doc(b.column(1)), b.column(1).flatten().to_numpy()
            more = b.column(4).flatten()
            at = np.searchsorted(of, doc(b.column(4))) + more.field("at").to_numpy()
            scores = []
            for k, name in ((2, "short"), (3, "long")):
                sums = b.column(k).flatten().to_numpy().copy()
                sums[at] += more.field(name).to_numpy()
                scores.append(pa.array(np.rint(STEP * _middle_of(of, bytes_, sums / bytes_, len(b))).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), *scores], ["_q_id", *SCORES])

    return waiting.select("_q_id", *CHUNKS).join(lists, "_q_id").mapInArrow(lean(run), ", ".join(["_q_id long", *(f"{c} int" for c in SCORES)]))


def bands(scored: DataFrame, width: float = WIDTH, floor: float = FLOOR) -> DataFrame:
    """(language, middles, spreads) of both scores from all documents that pass the base rules: exact medians from histograms
    of the rounded scores, a few thousand rows for each language at most. Null is a language of its own."""
    base = scored.where(~base_failed()).select(F.col("lang").alias("_l"), F.posexplode(F.array(*SCORES)).alias("_k", "_s"))
    rows = base.groupBy("_l", "_k", "_s").agg(F.count("*").alias("n")).toPandas()
    out = {}
    for (name, _), g in rows.sort_values(["_k", "_s"]).groupby(["_l", "_k"], dropna=False):
        mid = _median(g["_s"].to_numpy(), g["n"].to_numpy())
        off = np.abs(g["_s"].to_numpy() - mid)
        o = np.argsort(off, kind="stable")
        spread = max(width * _median(off[o], g["n"].to_numpy()[o]), floor * STEP)
        out.setdefault(_name(name), []).extend([float(mid), float(spread)])
    return scored.sparkSession.createDataFrame([(k, *v) for k, v in out.items()], "_l string, _mid double, _spread double, _mid_long double, _spread_long double")


def _name(x):
    return None if x is None or x != x else x


def _median(values: np.ndarray, counts: np.ndarray) -> float:
    return float(values[np.searchsorted(np.cumsum(counts), (counts.sum() + 1) // 2)])


def base_failed():
    n = F.col("_q_n_words")
    return (n < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT * n)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = MAX_GRAMS) -> dict[str | None, tuple[KneserNey, KneserNey]] | Cut:
    """The models of orders SHORTER and ORDER for each language with a document that passes the base rules; where they have more than
    `most` n-grams, the log probabilities of the most frequent ones, and a way to ask for all others."""
    spark = docs.sparkSession
    grams = Scratch(spark, "ngrams").save(count_grams(docs, lang, text), "grams")
    level = F.floor(4 * F.log2("n")).cast("int")  # counts on a logarithmic scale
    hist = grams.groupBy("lang", level.alias("level")).agg(F.count("*").alias("size")).toPandas().sort_values("level", ascending=False)
    if hist["size"].sum() > most:
        share, least = most // hist["lang"].nunique(dropna=False), []
        for name, g in hist.groupby("lang", dropna=False, sort=False):
            fits = g["level"][g["size"].cumsum() <= share]
            least.append((_name(name), int(fits.min() if len(fits) else g["level"].max() + 1)))
        least = spark.createDataFrame(least, "_l string, _least int")
        top = grams.join(F.broadcast(least), F.col("lang").eqNullSafe(F.col("_l"))).where(level >= F.col("_least")).select("lang", "gram")
        buckets = -(-int(hist["size"].sum()) // PART)
        held = spark.sparkContext.broadcast(_whole_models(grams, buckets))
        out = Cut()
        out.ask = lambda asked: _ask(grams, asked, buckets, held)
        for name, (g, short, long) in _by_language(out.ask(top).toArrow(), "gram", "short", "long"):
            few, at = np.unique(g & (1 << 8 * SHORTER) - 1, return_index=True)
            out[name] = Frequent(few, short[at]), Frequent(g, long)
        for name in held.value:
            out.setdefault(name, tuple(Frequent(np.zeros(0, np.int64), np.zeros(0)) for _ in range(2)))
        return out
    out = {}
    for name, (g, n) in _by_language(grams.toArrow(), "gram", "n"):
        short, back = np.unique(g & (1 << 8 * SHORTER) - 1, return_inverse=True)
        out[name] = KneserNey(short, np.bincount(back, weights=n), SHORTER), KneserNey(g, n, ORDER)
    return out


def _by_language(table: pa.Table, *columns: str) -> Iterator[tuple[str | None, list[np.ndarray]]]:
    names = table["lang"].combine_chunks().dictionary_encode()
    which = names.indices.fill_null(len(names.dictionary)).to_numpy()
    for k in np.unique(which).tolist():
        yield [*names.dictionary.to_pylist(), None][k], [table[c].to_numpy()[which == k] for c in columns]


def _bucket(buckets: int):
    """Of the two bytes before the predicted one."""
    return F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(buckets))


def _whole_models(grams: DataFrame, buckets: int) -> dict:
    """For each language the model of orders 1 and 2, which both models share, and the discounts from order 3 on of both, found
    by sums over buckets."""

    def sums(table: pa.Table) -> pa.Table:
        g, n = table["gram"].to_numpy(), table["n"].to_numpy()
        codes, c = KneserNey._shorter(g, n, ORDER, 3)
        short = np.bincount(np.searchsorted(codes[0], g & (1 << 8 * SHORTER) - 1), weights=n)
        pairs, seen = np.unique(codes[0] & 0xFFFF, return_counts=True)
        kind, key, size = [np.full(len(pairs), 2)], [pairs], [seen]
        for k, x in [(0, short), *enumerate(c, 3)]:  # 0: the order SHORTER of the shorter model
            kind, key, size = [*kind, np.full(4, k)], [*key, np.arange(1, 5)], [*size, np.array([(x == j).sum() for j in range(1, 5)])]
        cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in (kind, key, size)]
        name = pa.array([table["lang"][0].as_py()] * len(cols[0]), pa.string())
        return pa.table([name, *cols], ["lang", "kind", "key", "size"])

    found = grams.groupBy("lang", _bucket(buckets)).applyInArrow(sums, "lang string, kind long, key long, size long")
    out = {}
    for name, (kind, key, size) in _by_language(found.groupBy("lang", "kind", "key").agg(F.sum("size").alias("size")).toArrow(), "kind", "key", "size"):
        counts = lambda k: KneserNey._discounts_of([float(size[(kind == k) & (key == j)].sum()) for j in range(1, 5)])  # noqa: B023, E731
        out[name] = KneserNey(key[kind == 2], size[kind == 2], 2), {SHORTER: counts(0)}, {k: counts(k) for k in range(3, ORDER + 1)}
    return out


def _ask(grams: DataFrame, asked: DataFrame, buckets: int, held) -> DataFrame:
    """(lang, gram, short, long): log probabilities of the n-grams `asked` (lang, gram), each once, under both models of all `grams`."""

    def run(table: pa.Table) -> pa.Table:
        g, n, name = table["gram"].to_numpy(), table["n"].to_numpy(), table["lang"][0].as_py()
        want = g[n == 0]
        out = np.zeros((2, len(want)))
        if len(want):
            below, short, long = held.value[name]
            g, n = g[n > 0], n[n > 0]
            few, back = np.unique(g & (1 << 8 * SHORTER) - 1, return_inverse=True)
            out[0] = KneserNey.bucket(below, few, np.bincount(back, weights=n), SHORTER, short).log_p(want & (1 << 8 * SHORTER) - 1)
            out[1] = KneserNey.bucket(below, g, n, ORDER, long).log_p(want)
        return pa.table([pa.array([name] * len(want), pa.string()), pa.array(want), *map(pa.array, out)], ["lang", "gram", "short", "long"])

    both = grams.select("lang", "gram", "n").unionByName(asked.select("lang", "gram", F.lit(0).cast("long").alias("n")))
    return both.groupBy("lang", _bucket(buckets)).applyInArrow(run, "lang string, gram long, short double, long double")


@small_batches
def judge(docs: DataFrame, keep: list[str], lang: str = "lang", text: str = "text") -> DataFrame:
    """Columns `keep` of docs (the text among them or not), the counts as `_q_...`, `_q_score`, `_q_base_failed` and `_q_kept`;
    columns of these names in `docs` are left out.

    Null and empty texts have no words and fail the base rules. A language that no document passing the base rules has
    gets no model and no band, and its documents fail anyhow. Null languages form one. Rows are judged one by one:
    repeated rows get the same verdict. The models and bands come from all rows that pass the base rules. An empty table
    gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    ours = {"_q_score", "_q_base_failed", "_q_kept", *(f"_q_{k}" for k in FIELDS)}
    keep = [c for c in keep if c.lower() not in ours]
    models = fit(docs, lang, text)
    scored = scratch.save(score(docs, models, keep, lang, text), "scores")
    if isinstance(models, Cut):
        late = scratch.save(late_scores(scored, models.ask), "late")
        waits = F.col("_q_at").isNotNull()
        known, waiting = (scored.where(x).drop(*CHUNKS, *REST) for x in (~waits, waits))
        scored = known.unionByName(waiting.drop(*SCORES).join(late, "_q_id"))
    out = scored.join(F.broadcast(bands(scored)), F.col("lang").eqNullSafe(F.col("_l")), "left")
    wide = F.sqrt(1 + SHORT / F.greatest(F.col("_q_n_words"), F.lit(1)))
    inside = (F.abs(F.col("_q_score") - F.col("_mid")) <= F.col("_spread") * wide) & (F.col("_q_score_long") - F.col("_mid_long") <= F.col("_spread_long") * wide)
    kept = F.coalesce(~base_failed() & inside, F.lit(False))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *(f"_q_{k}" for k in FIELDS), "_q_score", base_failed().alias("_q_base_failed"), kept.alias("_q_kept"))


@small_batches
def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns as they are, whatever their names. Null and empty texts go, as all texts of
    few words; a row without an id or language is judged like others; of repeated rows all stay or go. An empty table
    stays empty. Texts are written once with their scores, so they are scored once."""
    names = docs.columns
    numbered = docs.select(F.col("text").alias("text"), F.col("lang").alias("lang"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c not in ("text", "lang")])
    kept = judge(numbered, numbered.columns).where("_q_kept")
    return kept.select(*[F.col(c if c in ("text", "lang") else f"c{i}").alias(c) for i, c in enumerate(names)])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = judge(docs, ["doc_id"])
    return out.select("doc_id", *(F.col(f"_q_{k}").alias(k) for k in FIELDS), F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_score").alias("score"))


def _model_sql(name: str, order: int, top: str) -> str:
    """CTEs of the model <name> of an order: n-grams as hexadecimal text with their counts (<name>_c<k>), discounts (_d<k>), weights of
    contexts (_x<k>) and probabilities (_p<k>)."""
    off = "CASE WHEN c < 1.5 THEN d0 WHEN c < 2.5 THEN d1 ELSE d2 END"
    out = [f"{name}_c{order} AS MATERIALIZED ({top})"]
    for k in range(order - 1, 0, -1):
        out.append(f"{name}_c{k} AS MATERIALIZED (SELECT lang, right(g, {2 * k}) AS g, count(*) AS c FROM {name}_c{k + 1} GROUP BY ALL)")
    for k in range(1, order + 1):
        raw = [f"CASE WHEN n{j} > 0 THEN {j} - {j + 1} * y * n{j + 1} / n{j} ELSE {j} * 0.5 END" for j in (1, 2, 3)]
        d = ", ".join(f"least(greatest({r}, 0.05), {j} - 0.05)::DOUBLE AS d{j - 1}" for j, r in enumerate(raw, 1))
        n = ", ".join(f"count(*) FILTER (c = {j})::DOUBLE AS n{j}" for j in (1, 2, 3, 4))
        out.append(f"{name}_d{k} AS MATERIALIZED (SELECT lang, {d} FROM (SELECT *, CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5::DOUBLE END AS y FROM (SELECT lang, {n} FROM {name}_c{k} GROUP BY lang)))")
        cut = f"(SELECT *, {off} AS off FROM {name}_c{k} JOIN {name}_d{k} USING (lang))"
        if k == 1:
            out.append(f"{name}_u AS MATERIALIZED (SELECT lang, sum(c)::DOUBLE AS total, sum(off) / sum(c) / 257 AS base FROM {cut} GROUP BY lang)")
            out.append(f"{name}_p1 AS MATERIALIZED (SELECT lang, g, base + greatest(c - off, 0) / total AS p FROM {cut} JOIN {name}_u USING (lang))")
            continue
        out.append(f"{name}_x{k} AS MATERIALIZED (SELECT lang, left(g, {2 * k - 2}) AS ctx, sum(c)::DOUBLE AS total, least(sum(off) / sum(c), 1) AS back FROM {cut} GROUP BY ALL)")
        out.append(f"{name}_p{k} AS MATERIALIZED (SELECT a.lang, a.g, greatest(c - off, 0) / total + back * l.p AS p FROM {cut} a JOIN {name}_x{k} x ON x.lang || x.ctx = a.lang || left(a.g, {2 * k - 2}) JOIN {name}_p{k - 1} l ON l.lang || l.g = a.lang || right(a.g, {2 * k - 2}))")
    log, joins = "ln(coalesce(p1.p, u.base))", f"JOIN {name}_u u ON u.lang = a.lang LEFT JOIN {name}_p1 p1 ON p1.lang || p1.g = a.lang || right(a.g, 2)"
    for k in range(2, order + 1):
        log = f"CASE WHEN p{k}.p IS NOT NULL THEN ln(p{k}.p) ELSE coalesce(ln(x{k}.back), 0) + {log} END"
        joins += f" LEFT JOIN {name}_p{k} p{k} ON p{k}.lang || p{k}.g = a.lang || right(a.g, {2 * k}) LEFT JOIN {name}_x{k} x{k} ON x{k}.lang || x{k}.ctx = a.lang || left(right(a.g, {2 * k}), {2 * k - 2})"
    out.append(f"{name} AS MATERIALIZED (SELECT a.lang, a.g, -({log}) AS nll FROM (SELECT DISTINCT lang, g FROM pos) a {joins})")
    return ",\n".join(out)


#: The counts, the models and the bands in SQL; doc_id is taken to be unique.
SQL = f"""
WITH w AS (SELECT doc_id, coalesce(lang, chr(1)) AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
tri AS (SELECT doc_id, i, x, lead(x, 1) OVER v AS y, lead(x, 2) OVER v AS z FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w) WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM tri WHERE z IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM rep GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
q AS (
  SELECT w.doc_id, lang, l, len(l) AS n_words, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)
), b AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM q),
hx AS (SELECT doc_id, lang, base_failed, '{"02" * (ORDER - 1)}' || hex(encode(array_to_string(l, ' '))) || '03' AS h FROM b WHERE n_words > 0),
part AS (SELECT doc_id, lang, base_failed, k, h[{2 * CHUNK} * k + 1:{2 * CHUNK} * k + {2 * CHUNK - 2 + 2 * ORDER}] AS h FROM (SELECT *, unnest(range(0, len(h) // {2 * CHUNK} + 1)) AS k FROM hx)),
pos AS MATERIALIZED (SELECT doc_id, lang, base_failed, k, h[2 * i + 1:2 * i + {2 * ORDER}] AS g FROM (SELECT *, unnest(range(0, len(h) // 2 - {ORDER - 1})) AS i FROM part)),
{_model_sql("short", SHORTER, f"SELECT lang, right(g, {2 * SHORTER}) AS g, count(*) AS c FROM pos WHERE NOT base_failed GROUP BY ALL")},
{_model_sql("long", ORDER, "SELECT lang, g, count(*) AS c FROM pos WHERE NOT base_failed GROUP BY ALL")},
ch AS MATERIALIZED (SELECT doc_id, k, count(*) AS n, avg(short.nll) AS s, avg(long.nll) AS l FROM pos JOIN short USING (lang, g) JOIN long USING (lang, g) GROUP BY ALL),
upto AS (SELECT doc_id, s, l, sum(n) OVER (PARTITION BY doc_id ORDER BY s, k ROWS UNBOUNDED PRECEDING) AS us, sum(n) OVER (PARTITION BY doc_id ORDER BY l, k ROWS UNBOUNDED PRECEDING) AS ul, sum(n) OVER (PARTITION BY doc_id) AS n FROM ch),
sc AS (SELECT doc_id, CAST(round_even({STEP} * min(s) FILTER (2 * us >= n), 0) AS INT) AS score, CAST(round_even({STEP} * min(l) FILTER (2 * ul >= n), 0) AS INT) AS score_long FROM upto GROUP BY doc_id),
a AS MATERIALIZED (SELECT b.*, score, score_long FROM b LEFT JOIN sc USING (doc_id)),
mid AS MATERIALIZED (SELECT lang, list_sort(list(score))[(count(*) + 1) // 2] AS m, list_sort(list(score_long))[(count(*) + 1) // 2] AS m_long FROM a WHERE NOT base_failed GROUP BY lang),
band AS (SELECT lang, m, m_long, greatest({WIDTH} * list_sort(list(abs(score - m)))[(count(*) + 1) // 2], {FLOOR * STEP}) AS s, greatest({WIDTH} * list_sort(list(abs(score_long - m_long)))[(count(*) + 1) // 2], {FLOOR * STEP}) AS s_long FROM a JOIN mid USING (lang) WHERE NOT base_failed GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
  coalesce(NOT base_failed AND abs(score - m) <= s * sqrt(1 + {SHORT}::DOUBLE / greatest(n_words, 1)) AND score_long - m_long <= s_long * sqrt(1 + {SHORT}::DOUBLE / greatest(n_words, 1)), false) AS kept
FROM a LEFT JOIN band USING (lang)
"""
