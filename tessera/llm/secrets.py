"""Secrets by fixed patterns and a battery of randomness tests, in DataFrame functions only.

The patterns give the base spans. Beside them every run of at least ``LEAST`` token
characters, however long, is a candidate, tested whole. Its encoding is inferred from
its characters (hexadecimal in one case, base 32, base 64 or its URL form), which fixes
an alphabet, and three tests ask whether it could be random in it:

* chi-squared of the character counts against a uniform alphabet (upper tail),
* runs of characters above and below the alphabet's middle (two-sided),
* serial correlation of neighbours' places in the alphabet (two-sided).

The first takes the Wilson-Hilferty cube root, all the normal distribution; the least
p-value counts as the least of three (1 - (1 - p)^3), so that the token's is near
uniform if it is random. Text is not, so its p-values lie near 0.

What is reported are the candidates with p above a cut-off, so a false discovery is
text among them. Candidates hold letters and digits and have the entropy that their
length lets a random token have. In each class of length, those with p above
``PASS`` give the number of random ones (a share 1 - ``PASS`` of them lies there), so
of the candidates above a cut-off c all but (1 - c) times that number are taken for
text; the least c (not below ``LEAST_P``) is used at which they are at most ``RATE`` of
what is reported. The counts come from a histogram of p-values (a fixed number of
rows, whatever the corpus). The estimate sees no text that passes the battery at
``PASS``; the tests measure how much does. A span of kind ``random`` touches no base span.

A match's place is a running sum of the gaps between a pattern's matches (``split``)
and their lengths, over the rows of a text's matches, so a text's cost grows with its
matches and no text leaves the scan.

Edge cases: null text is an empty one; texts and tokens are read whole; spans are in
code points, end exclusive; every row, repeated ones and those without id too, is
scanned by itself and gives one row; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # a run is matched whole, so its least length can stand in the pattern
HEX = "[0-9a-f]{16,}"
#: Least length of a token, and characters of a token that are split at once.
LEAST, PART = 20, 1024
TOKEN = "[A-Za-z0-9+/_-]{%d,}" % LEAST
KINDS = ("assign", "access", "hex", "random")

#: Share of text among reported tokens, level at which random tokens are counted, least p-value reported.
RATE, PASS, LEAST_P = 0.1, 0.1, 0.001
#: Bins of a p-value's power of ten; length from which all tokens are one class.
STEPS, LONG = 4, 256

#: Alphabets in order, tried one after another (fixed values).
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_INFER = {"hex": "^[0-9a-f]+$", "HEX": "^[0-9A-F]+$", "base32": "^[A-Z2-7]+$", "base64": "^[A-Za-z0-9+/]+$"}


def matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Array of (kind, number, gap before, length, value) of a pattern's matches, from the gaps between them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def one(x, i):
        sizes = F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size")
        return F.struct(F.lit(kind).alias("kind"), i.alias("k"), *sizes, x["value"].alias("value"))

    none = F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(rows, one)).otherwise(none)


def spans_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, value) of all matches; a row without a match has one record without a kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = F.concat(matches(text, 0, ASSIGN, 1), matches(text, 1, ACCESS), matches(text, 2, HEX), matches(text, 3, TOKEN))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), every.alias("m"))
    rows = rows.select("row", "doc_id", F.explode_outer("m").alias("m")).select("row", "doc_id", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    return rows.select("row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def two_sided(z: Column) -> Column:
    """P(|N| > |z|), by the logistic form 1 / (1 + exp(1.5976 z + 0.070566 z^3)) of one tail."""
    x = F.least(F.abs(z), F.lit(12.0))
    return 2 / (1 + F.exp(1.5976 * x + 0.070566 * x * x * x))


def battery(token: Column) -> dict[str, Column]:
    """The inferred encoding, the p-value of randomness and the entropy (bits a character)."""
    encoding = F.lit("base64url")
    for name in reversed(_INFER):
        encoding = F.when(F.rlike(token, F.lit(_INFER[name])), F.lit(name)).otherwise(encoding)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), encoding)
    n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
    own = F.when(encoding == "base64url", F.translate(token, "+/", "")).otherwise(token)  # characters of the alphabet
    return {"encoding": encoding, "n": n, "k": k, "alphabet": alphabet, "own": own}


def _tests(tokens: DataFrame) -> DataFrame:
    """Adds p (of the battery) and bits (entropy a character) to rows with ``token``."""
    rows = tokens.select("*", *[c.alias(name) for name, c in battery(F.col("token")).items()])
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    own, alphabet = F.col("own"), F.col("alphabet")
    counts = F.transform(F.split(alphabet, ""), lambda c: (F.length(own) - F.length(F.replace(own, c, F.lit("")))).cast("double"))
    rows = rows.withColumn("counts", F.filter(counts, lambda c: c > 0))
    n, k = F.col("n"), F.col("k")
    chi = total(F.col("counts"), lambda c: c * c) * k / n - n
    df = k - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    bits = total(F.col("counts"), lambda c: -(c / n) * F.log2(c / n))
    rows = rows.withColumn("z_chi", z_chi).withColumn("bits", bits)
    rows = rows.withColumn("half", k / 2).withColumn("mean", (k - 1) / 2)
    # parts overlap by one character, so that each pair of neighbours is in one part; bytes are cut without a scan
    last = F.greatest(F.floor((F.length(own) - 2) / PART), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.call_function("substring", own.cast("binary"), i * PART + 1, F.lit(PART + 1)).cast("string"))
    zero = F.struct(F.lit(None).cast("int").alias("a"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("serial"))

    def step(acc, b):
        turn = ((acc["a"] < F.col("half")) != (b < F.col("half"))).cast("double")
        product = (acc["a"] - F.col("mean")) * (b - F.col("mean"))
        return F.struct(b.alias("a"), (acc["turns"] + F.coalesce(turn, F.lit(0.0))).alias("turns"), (acc["serial"] + F.coalesce(product, F.lit(0.0))).alias("serial"))

    places = lambda part: F.transform(F.split(part, ""), lambda c: F.position(c, alphabet) - 1)
    rows = rows.withColumn("sums", F.transform(parts, lambda part: F.aggregate(places(part), zero, step)))
    turns, serial = total(F.col("sums.turns"), lambda x: x), total(F.col("sums.serial"), lambda x: x)
    variance = (k * k - 1) / 12
    z_runs = (turns - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
    z_serial = serial / (variance * F.sqrt(n - 1))
    upper = F.when(F.col("z_chi") > 0, two_sided(F.col("z_chi")) / 2).otherwise(1 - two_sided(F.col("z_chi")) / 2)
    least = F.least(upper, two_sided(z_runs), two_sided(z_serial))
    # 1 - (1 - least)^3, multiplied out so that small values keep their digits
    return rows.withColumn("p", F.least(F.lit(1.0), least * (3 - 3 * least + least * least))).drop("alphabet", "own", "counts", "sums", "half", "mean", "z_chi")


def _cut_offs(tests: DataFrame) -> DataFrame:
    """For each class of length the last bin of p-values whose tokens are reported."""
    step = 10 ** (-1 / STEPS)
    upto = Window.partitionBy("cls").orderBy("bin")
    every = Window.partitionBy("cls")
    steps = tests.groupBy("cls", "bin").agg(F.count("*").alias("m")).withColumn("above", F.sum("m").over(upto))
    passed = F.sum(F.when(F.pow(F.lit(step), F.col("bin") + 1) >= 0.999 * PASS, F.col("m")).otherwise(0)).over(every)
    steps = steps.withColumn("random", passed / (1 - PASS)).withColumn("c", F.pow(F.lit(step), F.col("bin") + 1))
    text = F.col("above") - F.col("random") * (1 - F.col("c"))
    good = (F.col("c") >= 0.999 * LEAST_P) & (text <= RATE * F.col("above"))
    return steps.filter(good).groupBy("cls").agg(F.max("bin").alias("last"))


def tested(tokens: DataFrame) -> DataFrame:
    """Rows with ``token`` that are candidates: with the battery's p, the class of length and the bin of p."""
    tests = _tests(tokens).withColumn("cls", F.floor(F.log2(F.least("n", F.lit(LONG))) * 2).cast("int"))
    # a random token of n characters shows about log2(min(n, k)) bits a character less a small loss; text shows less
    enough = F.col("bits") >= 0.8 * F.log2(F.least("n", "k"))
    mixed = F.rlike("token", F.lit("[0-9]")) & F.rlike("token", F.lit("[A-Za-z]"))
    return tests.filter(enough & mixed).withColumn("bin", F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * STEPS).cast("int"))


def random_tokens(tokens: DataFrame) -> DataFrame:
    """The distinct tokens that are reported."""
    tests = written(tested(tokens.distinct()), "tests")
    # one row for each class of length: two for each power of two up to LONG
    return tests.join(F.broadcast(_cut_offs(tests)), "cls").filter("bin <= last").select("token")


def scan(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and all spans of every document."""
    spans = written(spans_of(docs), "spans")
    is_token = F.coalesce(F.col("kind") == 3, F.lit(False))
    tokens = spans.filter(is_token).withColumnRenamed("value", "token")
    chosen = written(random_tokens(tokens.select("token")), "chosen").withColumn("is", F.lit(3))
    # records that are no span stay without a kind, so that their rows stay
    base = spans.filter(~is_token).withColumn("kind", F.when((F.col("kind") != 0) | (F.length("value") >= 12), F.col("kind")))
    tokens = tokens.join(chosen, "token", "left").withColumn("kind", F.col("is"))
    every = base.drop("value").unionByName(tokens.drop("token", "is"))
    # in the order of a base span's start and a token's end, all base spans that begin before a token's end precede it
    random = F.coalesce(F.col("kind") == 3, F.lit(False))
    before = Window.partitionBy("row").orderBy(F.when(random, F.col("end")).otherwise(F.col("start")), F.when(random, 0).otherwise(1))
    reach = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before.rowsBetween(Window.unboundedPreceding, 0))
    every = every.withColumn("reach", reach).filter(~random | (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    span = F.when(F.col("kind").isNotNull(), F.struct(F.col("start").cast("int").alias("start"), "kind", F.col("end").cast("int").alias("end")))
    out = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("every"))
    out = out.withColumn("base", F.filter("every", lambda s: s["kind"] < 3))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("every")).alias("spans"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
