"""Secret scans in DataFrame functions only: fixed patterns, and a character Markov model of random strings.

The patterns give spans of the kinds assign, access and hex. The method adds spans of the kind random: runs of 20 or
more key characters whose log-likelihood ratio between two first-order character models, one of random strings and
one of ordinary identifiers and words, is above a threshold per character, and which no other span overlaps. The ratio
alone decides. Both models are trained from labelled samples (`text`, `label`; 1 is random) and from labelled strings of the
scanned texts themselves: their words are ordinary, long values that the fixed patterns found are random. Character pairs
are counted in Spark; what reaches the driver is the 128 x 128 table of pair counts of each label, whatever the number
of samples and texts. Runs of fewer than 20 characters are not scored.

Positions: what a pattern splits off, and what it matches, alternate; running sums of their lengths are the spans.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

#: The contract's patterns.
ASSIGN = "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run of 16 or more; a shorter run holds no longer one
HEX = "[0-9a-f]{32,}"  # likewise for runs of 32 or more

#: Words of which ordinary identifiers are made.
PARTS = (
    "account action active address admin amount application array average batch begin block body branch buffer build "
    "button cache call cell change channel check child class clean client close cluster code collection color column "
    "command commit config connection content context control copy count create current customer data database date "
    "default delete delta description device dictionary directory display document domain download driver element "
    "email empty enable engine entry error event example executor export factory feature field file filter final find "
    "first flag folder format frame function generate global graph group handler hash header height history host id "
    "image import index info input instance internal item iterator job join journal label language large last layer "
    "length level library license line link list loader local lock logger main manager map market master match matrix "
    "member memory merge message method metric model module monitor name network node number object offset option "
    "order output owner package page parameter parent parse partition path pattern payment pixel place plan plugin "
    "point policy port position prefix previous primary print process product profile project property provider query "
    "queue random range rate reader record region register release remote report request resource response result "
    "return role root route row sample scale schedule schema scope script search segment select sequence server "
    "service session setting shape shard signal size sort source space split stage start state status step storage "
    "store stream string style success suffix summary support switch symbol system table target task template test "
    "text thread time timer title total trace transaction transform tree trigger type unit update upload url user "
    "utility value variable vector vendor version video view visitor volume wait warning weight width window word worker write zone"
).split()
RUN, THRESHOLD, SAMPLES = 20, 0.35, 6000


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """`n` random strings (base64, hexadecimal, upper-case alphanumerics, letters of one case, and lower-case ones with
    separators, cut from digests of a counter) and `n` ordinary ones: identifiers (two to four of PARTS, joined in snake,
    kebab, camel or path style, some with a number behind) and, one in fifty, rules of one or two separators."""
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(digest("b"))), "=|\\n", "")
    plain = lambda drop, x, y: F.regexp_replace(F.base64(F.unhex(F.concat(digest(x), digest(y)))), drop, "")
    letters = plain("[^A-Za-z]", "l", "m")
    random = F.when(i % 5 == 0, b64).when(i % 5 == 1, digest("h")).when(i % 5 == 2, F.upper(plain("[^A-Za-z0-9]", "u", "v")))
    random = random.when(i % 10 == 3, F.lower(letters)).when(i % 10 == 8, F.upper(letters)).otherwise(F.translate(F.lower(plain("[^A-Za-z0-9]", "s", "t")), "0123456789", "__--//_-/_"))
    size = (F.lit(20) + F.pmod(F.xxhash64(i), F.lit(40))).cast("int")
    random = F.substring(random, F.lit(1), size)
    word = lambda k: F.element_at(F.split(F.lit(" ".join(PARTS)), " "), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    used = F.slice(F.array(*[word(k) for k in range(4)]), 1, (F.lit(2) + i % 3).cast("int"))
    name = F.when(i % 5 == 0, F.array_join(used, "-")).when(i % 5 == 1, F.array_join(F.transform(used, F.initcap), "")).when(i % 5 == 2, F.array_join(used, "/")).when(i % 5 == 3, F.array_join(used, "")).otherwise(F.array_join(used, "_"))
    name = F.when(i % 7 == 0, F.concat(name, (i % 2000).cast("string"))).otherwise(name)
    mark = lambda k: F.substring(F.lit("-_=+/"), (k + 1).cast("int"), F.lit(1))
    one, two = F.floor(i / 50) % 5, F.pmod(F.xxhash64(i), F.lit(5))
    name = F.when(i % 50 == 49, F.repeat(F.concat(mark(one), F.when(i % 100 == 49, mark(one)).otherwise(mark(two))), F.floor(size / 2).cast("int"))).otherwise(name)
    base = spark.range(n)
    return base.select(random.alias("text"), F.lit(1).alias("label")).unionByName(base.select(name.alias("text"), F.lit(0).alias("label")))


def pair_counts(samples: DataFrame) -> DataFrame:
    """(label, pair, n): character pairs of (text, label, n), n being how often the text occurs, the first pair after a start mark
    (0). Characters beyond ASCII count as 127."""
    s = samples.where("text is not null and label is not null and length(text) > 0").select("label", F.concat(F.lit("\x00"), F.col("text")).alias("s"), "n")
    code = lambda i: F.least(F.ascii(F.substring(F.col("s"), i, F.lit(1))), F.lit(127))
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: code(i) * 128 + code(i + 1))
    return s.select("label", F.explode(pairs).alias("pair"), "n").groupBy("label", "pair").agg(F.sum("n").alias("n"))


def corpus_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(label, text, n): labelled strings of all texts and how often they occur. Ordinary (0) are words of 2 to 19 ASCII letters;
    random (1) are values of RUN characters or more that a fixed pattern found. Each string is one row from the first
    aggregate on, so the pairs of a word are taken apart once, however often it occurs."""
    t = F.col(text)
    words = F.filter(F.split(t, "[^A-Za-z0-9+/_=-]+"), lambda w: w.rlike("^[A-Za-z]{2,%d}$" % (RUN - 1)))
    found = F.concat(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(t, F.lit(HEX), F.lit(0)))
    found = F.when(t.rlike(f"{ASSIGN}|{ACCESS}|{HEX}"), F.filter(found, lambda v: F.length(v) >= RUN)).otherwise(F.array().cast("array<string>"))
    each = F.concat(F.transform(words, lambda w: F.struct(F.lit(0).alias("label"), w.alias("text"))), F.transform(found, lambda v: F.struct(F.lit(1).alias("label"), v.alias("text"))))
    return docs.where(t.isNotNull()).select(F.explode(each).alias("s")).select("s.*").groupBy("label", "text").agg(F.count("*").alias("n"))


def train(samples: DataFrame, smoothing: float = 0.5, docs: DataFrame | None = None, text: str = "text") -> list[float]:
    """Log-likelihood ratios (random over ordinary) of all 128 x 128 character pairs, add-`smoothing`. Pairs of the labelled
    strings of `docs` count too, those of a label together no more than those of its samples."""
    count = {0: [0.0] * 16384, 1: [0.0] * 16384}
    for r in pair_counts(samples.withColumn("n", F.lit(1))).collect():  # at most 2 x 16384 rows
        count[int(r["label"])][r["pair"]] += r["n"]
    if docs is not None:
        found = pair_counts(corpus_samples(docs, text)).collect()  # at most 2 x 16384 rows
        for label in (0, 1):
            mine = [r for r in found if r["label"] == label]
            part = min(1.0, sum(count[label]) / max(1, sum(r["n"] for r in mine)))
            for r in mine:
                count[label][r["pair"]] += part * r["n"]
    out = [0.0] * 16384
    for a in range(128):
        total = [sum(count[k][a * 128 : a * 128 + 128]) for k in (0, 1)]
        for b in range(128):
            p = [(count[k][a * 128 + b] + smoothing) / (total[k] + 66 * smoothing) for k in (0, 1)]
            out[a * 128 + b] = round(math.log(p[1] / p[0]), 4)
    return out


def _spans(text: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """Array of (start, end, rank, kind, value) of a pattern's matches, leftmost and non-overlapping. keep(group 1): which to return."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    steps = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), F.concat(F.array(F.lit(0)), F.transform(found, F.length)), lambda g, m: g + m)  # from start to start
    # a lambda works out again what it does not get as an argument, so matches, steps and sums of 256 steps are bound by one-element arrays
    bound = F.array(F.struct(found.alias("found"), steps.alias("steps")))
    bound = F.transform(bound, lambda z: F.struct(z["found"].alias("found"), z["steps"].alias("steps"), F.transform(F.sequence(F.lit(0), F.floor(F.size(z["steps"]) / 256).cast("int")), lambda c: total(F.slice(z["steps"], c * 256 + 1, F.lit(256)))).alias("sums")))

    def build(z):
        def one(m, i):
            k = F.floor((i + 1) / 256).cast("int")
            at = total(F.slice(z["sums"], F.lit(1), k)) + total(F.slice(z["steps"], k * 256 + 1, i + 1 - k * 256))
            return F.struct(at.cast("long").alias("start"), (at + F.length(m)).cast("long").alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m.alias("value"))

        return F.transform(z["found"], one)

    spans = F.transform(bound, build)[0]
    empty = F.array().cast("array<struct<start:bigint,end:bigint,rank:int,kind:string,value:string>>")
    if keep is not None:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), groups.alias("g")), lambda z: keep(z["g"])), lambda z: z["s"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def scan_secrets(docs: DataFrame, samples: DataFrame | None = None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `docs`, and `secret_spans`: array of (start, end, rank, kind, value) by start, then kind as listed
    (assign, access, hex, random); start and end are code points, end exclusive. A column of that name is replaced.

    A null text has no spans, as an empty one. Texts are scanned whole. Fixed-pattern spans of different kinds may
    overlap and all stay; a random span that touches another span is left out. Rows are judged one by one, so
    repeated rows and ties change nothing. An empty table stays empty.
    """
    llr = train(labelled_samples(docs.sparkSession) if samples is None else samples, docs=docs, text=text)
    table = F.from_json(F.lit(json.dumps(llr)), "array<double>")  # foldable: one literal in the plan
    ratios, fixed, marked = unused(docs.columns, "_ratios", "_fixed", "_runs")
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(_spans(t, ASSIGN, "assign", 0, lambda g: F.length(g) >= 8), _spans(t, ACCESS, "access", 1), _spans(t, HEX, "hex", 2))
    code = lambda v, i: F.when(i == 0, F.lit(0)).otherwise(F.ascii(F.substring(v, i, F.lit(1))))
    score = lambda v: F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0.0), lambda s, i: s + F.element_at(F.col(ratios), code(v, i - 1) * 128 + code(v, i) + 1))
    runs = _spans(t, "[A-Za-z0-9+/_=-]{%d,}" % RUN, "random", 3)
    likely = F.filter(runs, lambda r: score(r["value"]) > threshold * F.length(r["value"]))
    out = docs.withColumn(ratios, table).withColumns({fixed: base, marked: likely})
    clear = F.filter(marked, lambda r: ~F.exists(fixed, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    out = out.withColumn("secret_spans", F.array_sort(F.concat(fixed, clear)))
    return out.drop(ratios, fixed, marked)


def op4(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "secret_spans")
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = joined(F.filter("secret_spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
