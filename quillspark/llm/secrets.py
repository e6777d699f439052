"""Secret scans: fixed patterns and a randomness test battery, in DataFrame operations only.

The base kinds are three patterns.  The battery looks at every other run of key-like
characters.  It infers an encoding, the smallest alphabet that holds all characters of a
run (digits, hex, letters, base 32, letters and digits, base 64), and numbers the symbols
by how common they are in text.  Three statistics follow: chi-squared of the symbols
against even use; runs, the changes between the commoner and the rarer half of the
alphabet; and serial correlation of neighbours about the alphabet's middle.  Each has two
p values: under even use (small: not random) and under text of the same length (small:
not text, by the normal drift of text on that statistic).  Fisher's rule combines the
three of either kind.  A run is kept if randomness is not rejected and if its combined p
under text is a discovery by Benjamini-Hochberg within its class of length, from counts
in bins of log p, so a false discovery rate holds for short and long runs alike.

Defined results: a null or empty text has no spans; positions are code points, end
exclusive; repeated rows give repeated results; rows with a null id are scanned like
others; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.plans.staging import staged

#: Fixed: the base patterns, their kinds in order and the least length of what counts (group 2 of assign).
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that the battery looks at.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: False discovery rate, and the least combined p at which the tests against randomness let a run pass.
RATE, PASS = 0.01, 1e-4
_LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
#: Encodings, smallest alphabet first: the pattern of a run, its symbols from common in text to rare, and, for text, chi-squared
#: per character beyond chance, the rate of changes between the halves, and the serial correlation with its spread per character.
ENCODINGS = (
    ("^[0-9]+$", "0123456789", 1.0, 0.30, 0.30, 1.3),
    ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 2.0, 0.30, 0.35, 1.3),
    ("^([a-z]+|[A-Z]+)$", _LETTERS, 0.9, 0.28, 0.55, 1.0),
    ("^[A-Z2-7]+$", _LETTERS.upper() + "234567", 1.4, 0.20, 0.60, 1.0),
    ("^([0-9a-z]+|[0-9A-Z]+)$", _LETTERS + "0123456789", 1.7, 0.20, 0.70, 1.0),
    ("^.*$", "/+" + _LETTERS + _LETTERS.upper() + "0123456789", 3.2, 0.20, 0.80, 1.0),
)
#: Matches of one text that are added up together.
CHUNK = 256


def _let(value: Column, f) -> Column:
    """f(value), with value computed once: a lambda's argument is evaluated before its body."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Array of (start, end) of the matches, leftmost first, of at least `least` characters in the group.

    The parts between matches and the matches alternate, so running sums of their lengths are the positions.
    The patterns run over the text once each; sums run within chunks, so the time is linear in the matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else hits
    sized = F.zip_with(hits, kept, lambda h, k: F.struct(F.length(h).alias("len"), F.length(k).alias("kept")))
    steps = F.zip_with(F.split(text, pattern, -1), sized, lambda p, h: F.struct(F.length(p).alias("gap"), F.coalesce(h["len"], F.lit(0)).alias("len"), F.coalesce(h["kept"], F.lit(-1)).alias("kept")))
    span = "array<struct<s:int,e:int>>"
    start = lambda at: F.struct(at.alias("at"), F.array().cast(span).alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["len"]).alias("at"),
        F.when(x["kept"] >= least, F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["len"]).alias("e")))).otherwise(acc["out"]).alias("out"),
    )
    chunk = lambda acc, c: _let(
        F.aggregate(c, start(acc["at"]), step),
        lambda v: F.struct(v["at"].alias("at"), F.array_append(acc["out"], v["out"]).alias("out")),
    )
    chunks = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda i: F.slice(z, i * CHUNK + 1, F.lit(CHUNK)))
    whole = lambda z: F.aggregate(chunks(z), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), _let(steps, whole)).otherwise(F.array().cast(span))


def _normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0, to within 1e-7."""
    # Abramowitz and Stegun 26.2.17.
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    upper = F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _fisher(*p: str) -> Column:
    """The chance of a product of three even p values as small as theirs: chi-squared of six degrees of freedom."""
    half = -sum((F.log(F.greatest(F.least(F.col(x), F.lit(1.0)), F.lit(1e-100))) for x in p), F.lit(0.0))
    return F.exp(-half) * (1 + half + half * half / 2)


def _by_encoding(values) -> Column:
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(F.col("encoding") == i, F.lit(values[i])).otherwise(out)
    return out


def battery(runs: DataFrame) -> DataFrame:
    """runs(run string) -> also encoding, k (its alphabet), n, chi, changes, serial and the p values; run is not null.

    p_even, p_runs, p_serial and p_random: under even use.  t_even, t_runs, t_serial and p_text: under text.
    """
    encoding = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        encoding = F.when(F.col("run").rlike(ENCODINGS[i][0]), F.lit(i)).otherwise(encoding)
    r = runs.withColumn("n", F.length("run").cast("double")).withColumn("encoding", encoding)
    symbols, drift, rate, corr, spread = (_by_encoding([e[i] for e in ENCODINGS]) for i in range(1, 6))
    k = F.length(symbols).cast("double")
    # case says nothing where there is only one
    body = F.when(F.col("encoding") == 3, F.col("run")).otherwise(F.when(F.col("run").rlike("[a-z]") & F.col("run").rlike("[A-Z]"), F.col("run")).otherwise(F.lower("run")))
    body = F.translate(body, "-_", "+/")
    r = r.withColumn("k", k).withColumn("symbols", _let(symbols, lambda a: F.transform(F.slice(F.split(body, ""), 1, F.length("run")), lambda c: (F.position(c, a) - 1).cast("double"))))
    zero = F.lit(0.0)
    # squares of the counts from the sorted symbols: each adds twice its place among its equals, less one
    squares = F.aggregate(
        F.array_sort("symbols"), F.struct(F.lit(-1.0).alias("last"), zero.alias("place"), zero.alias("sum")),
        lambda a, x: _let(F.when(x == a["last"], a["place"] + 1).otherwise(F.lit(1.0)), lambda p: F.struct(x.alias("last"), p.alias("place"), (a["sum"] + 2 * p - 1).alias("sum"))),
        lambda a: a["sum"],
    )
    middle, unit = (F.col("k") - 1) / 2, F.sqrt((F.col("k") * F.col("k") - 1) / 12)
    pairs = F.aggregate(
        "symbols", F.struct(F.lit(None).cast("double").alias("last"), zero.alias("changes"), zero.alias("serial")),
        lambda a, x: F.struct(
            x.alias("last"),
            (a["changes"] + F.when((x > middle) != (a["last"] > middle), 1.0).otherwise(0.0)).alias("changes"),
            (a["serial"] + F.coalesce((x - middle) * (a["last"] - middle), zero)).alias("serial"),
        ),
    )
    r = r.withColumn("chi", squares * F.col("k") / F.col("n") - F.col("n")).withColumn("pairs", pairs)
    m = F.greatest(F.col("n") - 1, F.lit(1.0))
    r = r.withColumn("changes", F.col("pairs.changes")).withColumn("serial", F.col("pairs.serial") / (unit * unit) / m)
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is near normal
    d = F.col("k") - 1
    z_even = (F.pow(F.col("chi") / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
    extra = F.col("n") * drift
    r = r.select(
        "run", "encoding", "k", "n", "chi", "changes", "serial",
        _normal_tail(z_even).alias("p_even"), (2 * _normal_tail(F.abs(F.col("changes") - m / 2) / F.sqrt(m / 4))).alias("p_runs"), (2 * _normal_tail(F.abs(F.col("serial")) * F.sqrt(m))).alias("p_serial"),
        _normal_tail((d + extra - F.col("chi")) / F.sqrt(2 * d + 4 * extra)).alias("t_even"),
        _normal_tail((F.col("changes") - m * rate) / F.sqrt(m * rate * (1 - rate))).alias("t_runs"),
        _normal_tail((corr - F.col("serial")) * F.sqrt(m) / spread).alias("t_serial"),
    )
    return r.withColumn("p_random", _fisher("p_even", "p_runs", "p_serial")).withColumn("p_text", _fisher("t_even", "t_runs", "t_serial"))


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of tested(run, n, p_..) that are random and, by Benjamini-Hochberg within their class of length, not text.

    Counts per bin of log p stand for the sorted list of p: at most 2,000 bins a class, whatever the input.
    """
    r = tested.withColumn("length_class", F.floor(F.log2(F.col("n").cast("double")) * 2).cast("int"))
    r = r.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(1999), F.floor(-F.log10(F.greatest("p_text", F.lit(1e-100))) * 20))).cast("int"))
    counts = r.groupBy("length_class", "bin").agg(F.count("*").alias("rows"))
    down = Window.partitionBy("length_class").orderBy(F.col("bin").desc())
    every = Window.partitionBy("length_class")
    # p of a bin is at most 10 ** (-bin / 20)
    counts = counts.withColumn("found", F.sum("rows").over(down)).withColumn("tests", F.sum("rows").over(every))
    least = counts.where(F.pow(F.lit(10.0), -F.col("bin") / 20) * F.col("tests") <= F.lit(rate) * F.col("found")).groupBy("length_class").agg(F.min("bin").alias("least_bin"))
    return r.where(F.col("p_random") >= PASS).join(F.broadcast(least), "length_class").where("bin >= least_bin")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """-> doc_id, base array<struct<kind,s,e>> and spans (base and random, in order); one row per input row, with text and the whole row if asked for."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if keep_row else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *more)
    found = rows.select(
        "doc_id", *(["text", "row"] if keep_row else []),
        _spans(F.col("text"), ASSIGN, 1, 6).alias("assign"), _spans(F.col("text"), ACCESS).alias("access"),
        _spans(F.col("text"), HEX).alias("hex"), _spans(F.col("text"), CANDIDATE).alias("candidate"),
        F.when(F.col("text").rlike(CANDIDATE), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("runs"),
    )
    # a number for each row, fixed by being written
    found = staged(found.withColumn("row_key", F.monotonically_increasing_id()))
    tag = lambda name, i: F.transform(F.col(name), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))
    base = F.array_sort(F.concat(tag("assign", 0), tag("access", 1), tag("hex", 2)))
    runs = found.where(F.size("candidate") > 0).select("row_key", F.inline(F.arrays_zip("candidate", "runs"))).select("row_key", F.col("candidate.s").alias("s"), F.col("candidate.e").alias("e"), F.col("runs").alias("run"))
    # runs that overlap a base span: base spans of a row that has runs, one by one, against the runs in order
    spans = found.where((F.size("candidate") > 0) & (F.size(F.concat("assign", "access", "hex")) > 0)).select("row_key", F.inline(F.concat("assign", "access", "hex")))
    ends = Window.partitionBy("row_key").orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = lambda frame, run: frame.select("row_key", F.inline(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("e").alias("at"), F.lit(0).alias("opens")))), run.alias("run"), "s", "e")
    marks = edge(runs, F.col("run")).union(edge(spans, F.lit(None).cast("string")))
    is_base = F.col("run").isNull()
    marks = marks.withColumn("open", F.sum(F.when(is_base, 2 * F.col("opens") - 1).otherwise(0)).over(ends)).withColumn("begun", F.sum(F.when(is_base, F.col("opens")).otherwise(0)).over(ends))
    clear = marks.where(~is_base).groupBy("row_key", "s", "e").agg(F.max("open").alias("open"), F.min("begun").alias("lo"), F.max("begun").alias("hi"), F.max("run").alias("run")).where("open = 0 and lo = hi")
    runs = clear.select("row_key", "s", "e", "run")
    tested = staged(battery(runs.select("run").distinct().repartition("run")))
    hits = runs.join(discoveries(tested).select("run"), "run")
    hits = hits.groupBy("row_key").agg(F.collect_list(F.struct("s", F.lit(3).alias("k"), "e")).alias("extra"))
    out = found.withColumn("base", base).join(hits, "row_key", "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return out.select("doc_id", *(["text", "row"] if keep_row else []), "assign", "access", "hex", "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests per document."""
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redacted(mask: str = "[REDACTED]") -> Column:
    """Over scan(keep_row=True): the text with every span replaced by the mask; overlapping spans by one.

    Spans are first merged into gaps to keep, then pieces of the text are cut out by position, in chunks.
    """
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("keep")),
        lambda acc, x: F.when(
            x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.array_append(acc["keep"], F.struct(acc["at"].alias("s"), x["s"].alias("e"))).alias("keep"))
        ).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["keep"].alias("keep"))),
    )
    body = lambda v: F.concat(
        F.array_join(F.transform(v["keep"], lambda g: F.concat(F.substr(F.col("text"), g["s"] + 1, g["e"] - g["s"]), F.lit(mask))), ""),
        F.substr(F.col("text"), v["at"] + 1),
    )
    return F.when(F.size("spans") > 0, _let(merged, body)).otherwise(F.col("text"))


def masked(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every span masked in text, and n_chars, where there is one, counted again for changed rows; all other columns as they are.

    Only rows with something to look at are scanned; all other rows are passed on as they are, and no text is shuffled
    unless spans are many.
    """
    some = F.coalesce(F.col("text").rlike(f"{ASSIGN}|{CANDIDATE}"), F.lit(False))
    looked, rest = docs.where(some), docs.where(~some)
    found = scan(looked, keep_row=True)
    found = found.select("row", "spans", redacted(mask).alias("masked_text"))
    changed = F.size("spans") > 0
    cells = {"text": F.when(changed, F.col("masked_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        cells["n_chars"] = F.when(changed, F.length("masked_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rest.unionByName(found.select(*[cells.get(c, F.col("row")[c]).alias(c) for c in docs.columns]))
