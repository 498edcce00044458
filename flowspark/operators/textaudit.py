"""Figures in texts and their comparison with facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.lineage import cut

#: Month names in English, French, German and Spanish, and units of a figure.
MONTHS = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sept sep oct nov dec "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "januar februar märz juni juli oktober dezember enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
).split()
UNITS = "% × x times fois mal veces kwh mwh wh km °c mm/h mm h min s".split()
#: Words and signs that call a figure approximate.
APPROXIMATE = ["about", "around", "roughly", "approximately", "approx", "nearly", "almost", "some", "environ", "presque", "quasi", "circa", "ca"]
APPROXIMATE_TWO = ["près de", "autour de"]
APPROXIMATE_SIGNS = ("~", "≈")
#: Separators of thousands inside a figure: no-break, thin and narrow no-break space.
THIN = "\u00a0\u2009\u202f"
#: Line ends as words of their own, and what stands for a code span.
LINE_END, CODE = "\u23ce", "\u25c6"
DASHES = ["-", "–", "—"]
#: A figure at the beginning of a part of a word: signs that belong to no word, sign of the number, digits with separators, the rest.
_FIGURE = rf"^([^\p{{L}}\p{{N}}/.:,+−-]*)([-+−]?)(\p{{Nd}}[\p{{Nd}}.,{THIN}]*)(.*)$"


def _without_code(text: Column) -> Column:
    """Text without the spans between backticks; a single backtick opens no span."""
    parts = F.split(text, "`")
    inside = lambda i: (i % 2 == 1) & (i < F.size(parts) - 1)
    return F.when(text.contains("`"), F.array_join(F.transform(parts, lambda p, i: F.when(inside(i), F.lit(f" {CODE} ")).otherwise(p)), " ")).otherwise(text)


def _digit_words(texts: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """One row per word with a digit and the words next to it: (key, w, b2, b1, a1, a2, a3). Each text is split once."""
    words = texts.select(*key, F.split(F.replace(_without_code(F.col(text_col)), F.lit("\n"), F.lit(f" {LINE_END} ")), r"\s+").alias("_w"))
    at = F.filter(F.transform("_w", lambda w, i: F.when(w.rlike("[0-9]"), i)), lambda i: i.isNotNull())
    word = lambda i, d: F.when(i + d >= 0, F.get("_w", i + d))
    near = F.transform(at, lambda i: F.struct(word(i, 0).alias("w"), *[F.coalesce(word(i, d), F.lit("")).alias(n) for n, d in (("b2", -2), ("b1", -1), ("a1", 1), ("a2", 2), ("a3", 3))]))
    return words.select(*key, F.explode(near).alias("n")).select(*key, "n.*")


def _bare(c: Column) -> Column:
    """A word without quotes, brackets, emphasis and punctuation around it."""
    return F.btrim(c, F.lit("\"'()[]«»“”.,;:!?*_"))


def _number_between(c: Column, low: int, high: int) -> Column:
    return F.coalesce(F.when(F.length(c) <= 4, c.try_cast("int")).between(low, high), F.lit(False))


def _is_date(word: Column) -> Column:
    """Year, month and day joined by hyphens, with or without a time behind."""
    p = F.split(_bare(word), "-")
    return (F.size(p) == 3) & _number_between(p[0], 1000, 9999) & (F.length(p[1]) == 2) & _number_between(F.get(p, F.lit(1)), 1, 12) & _number_between(F.substring(F.get(p, F.lit(2)), 1, 2), 1, 31)


def _skipped(t: DataFrame) -> Column:
    """Words whose digits state no figure: links, notes, dates and the times behind them, names of lines, list numbers, days of a month."""
    w, bare = F.col("w"), _bare(F.col("w"))
    month = lambda c: F.lower(_bare(F.col(c))).isin(MONTHS)
    line = F.substring(bare, 1, 1).isin("U", "S") & _number_between(F.substring(bare, 2, 9), 0, 99)
    digits = F.rtrim(bare, F.lit("stndrhe."))
    day = (F.length(digits) <= 2) & digits.try_cast("int").isNotNull() & (month("a1") | month("b1"))
    number = F.rtrim(w, F.lit(".)"))
    listed = (F.length(w) == F.length(number) + 1) & number.try_cast("long").isNotNull() & F.col("b1").isin("", LINE_END, "#", "##", "###")
    note = (w.startswith("[") & F.ltrim(w, F.lit("[^")).substr(1, 1).between("0", "9") & w.contains("]"))
    return w.contains("://") | note | _is_date(w) | (_is_date(F.col("b1")) & w.contains(":")) | line | (bare == "24/7") | listed | day


def _figure_parts(t: DataFrame, key: list[str]) -> DataFrame:
    """Words cut at dashes, and at hyphens behind a digit: (key, part, first, of_minutes, ...).

    Of numbers joined by a hyphen the first one counts, since the second can't be told from a negative number; a range of minutes counts as none.
    """
    pieces = F.flatten(F.transform(F.split("w", "[–—]"), lambda s: F.transform(F.split(s, "(?<=[0-9])-"), lambda p, i: F.struct(p.alias("p"), (i == 0).alias("first")))))
    minutes = lambda c: F.lower(c).startswith("min")
    digit = lambda c: c.rlike("^[^\\p{L}]*[0-9]")
    x = t.withColumn("_p", pieces)
    last = F.element_at("_p", -1)["p"]
    several = F.size(F.filter("_p", lambda p: digit(p["p"]))) > 1
    own = several & (minutes(F.col("a1")) | minutes(F.ltrim(last, F.lit("0123456789 "))))
    apart = (F.col("a1").isin(DASHES) & digit(F.col("a2")) & minutes(F.col("a3"))) | (F.col("b1").isin(DASHES) & digit(F.col("b2")) & minutes(F.col("a1")))
    slot = (_bare(F.element_at("_p", 1)["p"]) == "15") & (minutes(F.coalesce(F.get("_p", F.lit(1))["p"], F.lit(""))) | minutes(F.col("a1")) | (F.lower("b1") == "per"))
    glued_slot = F.lower(F.col("w")).startswith("15min")
    x = x.where(~(own | apart | slot | glued_slot))
    two = F.concat_ws(" ", F.lower("b2"), F.lower("b1"))
    near = F.lower(_bare(F.col("b1"))).isin(APPROXIMATE) | two.isin(APPROXIMATE_TWO) | F.rtrim(F.col("b1"), F.lit("*")).isin(*APPROXIMATE_SIGNS) | F.substring(F.ltrim("w", F.lit("*(")), 1, 1).isin(*APPROXIMATE_SIGNS)
    return x.select(*key, "w", "a1", near.alias("near"), F.explode("_p").alias("_x")).select(*key, "w", "a1", "near", F.col("_x.p").alias("part"), F.col("_x.first").alias("first"))


def figures(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Figures of whole texts: (key, kind time|number, raw, value, unit, decimals, tol).

    Bare counts up to ten carry no claim and are left out. A round or an approximate figure from 100 on has a tolerance of 1.2 %, a smaller
    approximate one twice that of its last digit.
    """
    t = _digit_words(texts, key, text_col)
    t = _figure_parts(t.where(~_skipped(t)), key)
    halves = F.split("part", ":")
    hour, minute = F.regexp_extract(halves[0], "([0-9]+)$", 1), F.regexp_extract(F.get(halves, F.lit(1)), "^([0-9]+)", 1)
    clock = (F.size(halves) == 2) & (F.length(minute) == 2) & _number_between(hour, 0, 23) & _number_between(minute, 0, 59) & (F.length(hour) <= 2)
    times = t.where(clock).select(*key, F.lit("time").alias("kind"), F.concat_ws(":", hour, minute).alias("raw"), (hour.cast("double") * 60 + minute.cast("double")).alias("value"))
    group = lambda i: F.regexp_extract("part", _FIGURE, i)
    n = t.where(~F.coalesce(clock, F.lit(False)) & F.col("first")).select("*", group(2).alias("_s"), F.rtrim(group(3), F.lit(".,")).alias("_d"), _bare(F.lower(group(4))).alias("_t"), group(4).alias("_end"))
    n = n.where(F.col("_d") != "")
    glued = F.when(F.col("_t").rlike(r"[\p{L}\p{N}/:%×°]"), F.col("_t")).otherwise("")
    own = F.lower(_bare(F.col("a1")))
    closed = F.col("_end").rlike("[.,;:!?)]$") | F.col("w").rlike("[.,;:!?)]$")
    unit = F.when(glued != "", glued).when(~closed & own.isin(UNITS), own).otherwise("")
    n = n.where((glued == "") | glued.isin(UNITS))
    n = n.where(~((F.col("_s") == "") & (unit == "") & (F.length("_d") == 4) & _number_between(F.col("_d"), 1900, 2099)))
    plain = F.regexp_replace(F.translate("_d", THIN, ""), r",(?=\d{3}(?:\D|$))", "")
    value = F.concat(F.when(F.col("_s").isin("", "+"), "").otherwise("-"), F.replace(plain, F.lit(","), F.lit(".")))
    shown = F.trim(F.concat_ws(" ", F.concat("_s", F.translate("_d", THIN, "   ")), F.nullif(unit, F.lit(""))))
    n = n.select(*key, F.lit("number").alias("kind"), shown.alias("raw"), unit.alias("unit"), "near", value.alias("_v"))
    n = n.select("*", F.col("_v").try_cast("double").alias("value"), F.length(F.regexp_extract("_v", r"\.(\d+)$", 1)).alias("decimals")).filter("value IS NOT NULL")
    n = n.filter(~((F.col("decimals") == 0) & (F.col("unit") == "") & (F.abs("value") <= 10)))
    tol, large = 0.5 * F.pow(F.lit(10.0), -F.col("decimals")), (F.col("decimals") == 0) & (F.abs("value") >= 100)
    rounded = large & ((F.abs("value") % 10 == 0) | F.col("near"))
    n = n.withColumn("tol", F.when(rounded, F.greatest(tol, 0.012 * F.abs("value"))).when(F.col("near"), 2 * tol).otherwise(tol))
    times = times.withColumns({"unit": F.lit("hh:mm"), "decimals": F.lit(0), "tol": F.lit(0.0)})
    return n.drop("near", "_v").unionByName(times)


def sentences(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Sentences and table rows with their position; a table row carries its header."""
    lines = texts.select(*key, F.posexplode(F.split(text_col, r"\n")).alias("line_no", "line"))
    row = F.col("line").rlike(r"^\s*\|")
    w = Window.partitionBy(*key).orderBy("line_no")
    x = lines.withColumn("is_row", row).withColumn("new", F.when(row & ~F.coalesce(F.lag(row).over(w), F.lit(False)), 1).otherwise(0))
    x = x.withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.first("line").over(Window.partitionBy(*key, "block", "is_row").orderBy("line_no"))
    x = x.withColumn("header", F.when(row, head))
    x = x.withColumn("part", F.when(row, F.array("line")).otherwise(F.split("line", r"(?<=[.!?])\s+")))
    return x.select(*key, "line_no", "header", F.posexplode("part").alias("sentence_no", "sentence")).filter(F.trim("sentence") != "")


def flatten_json(docs: DataFrame, key: str, json_col: str, depth: int | None = None) -> DataFrame:
    """Leaf values of nested JSON: (key, path, parent, value text, number), at any depth or down to ``depth``."""
    cur = docs.select(key, F.lit("").alias("path"), F.lit("").alias("parent"), F.try_parse_json(json_col).alias("v")).filter("v IS NOT NULL")
    out = None
    level = 0
    while depth is None or level < depth:
        level += 1
        if depth is None and cur.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).limit(1).count() == 0:
            break
        obj = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
        leaf = cur.filter(~obj).select(key, "path", "parent", F.try_variant_get("v", "$", "string").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        nxt = cur.filter(obj).lateralJoin(cur.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("_k"), F.col("value").alias("_v")))
        name = F.coalesce("_k", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        cur = nxt.select(key, F.concat_ws(".", F.nullif("path", F.lit("")), name).alias("p2"), F.col("path").alias("parent"), F.col("_v").alias("v"))
        cur = cur.withColumnRenamed("p2", "path").select(key, "path", "parent", "v")
    leaf = cur.filter(~F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).select(key, "path", "parent", F.try_variant_get("v", "$", "string").alias("value"))
    out = leaf if out is None else out.unionByName(leaf)
    return out.withColumn("number", F.col("value").try_cast("double"))


def _bucket(x: Column) -> Column:
    return F.floor(F.log2(F.abs(x) + 1) * 8)


def readings(figs: DataFrame) -> DataFrame:
    """Numbers a figure may stand for: itself, and for a percentage the share and the factors."""
    pct = F.col("unit").startswith("%")
    v, tol = F.abs("value"), F.col("tol")
    st = lambda a, b: F.struct(a.alias("c"), b.alias("ct"))
    alt = F.when(pct, F.array(st(v, tol), st(v / 100, tol / 100), st(1 + F.col("value") / 100, tol / 100), st(1 - v / 100, tol / 100))).otherwise(F.array(st(v, tol)))
    return figs.withColumn("_a", F.explode(alt)).select("*", F.abs("_a.c").alias("cand"), F.col("_a.ct").alias("ctol")).drop("_a")


#: Facts of one parent that are paired with each other.
FEW_FACTS = 16
#: Beyond every fact: the end of an interval without an upper bound.
_BEYOND = 1e15


def _in_buckets(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Rows once for each bucket between two positive bounds."""
    return df.withColumn("_b", F.explode(F.sequence(_bucket(F.greatest(lo, F.lit(0.0))), _bucket(F.least(F.greatest(hi, lo, F.lit(0.0)), F.lit(_BEYOND))))))


def _context_score(own: tuple[str, ...], given: tuple[str, ...]) -> tuple[Column, Column]:
    """Whether the contexts of a figure and a fact agree, and how well: two for a common station, one for a common time, up to two for common words."""
    ok, score = F.lit(True), F.lit(0)
    for name, weight, most in (("stations", 2, 1), ("times", 1, 1), ("words", 1, 2)):
        if name in own and name in given:
            common = F.size(F.array_intersect(F.col(name), F.col(f"_{name}")))
            score = score + weight * F.least(common, F.lit(most))
            if name != "words":  # another station or another time is another fact
                ok = ok & ((F.size(name) == 0) | (F.size(f"_{name}") == 0) | (common > 0))
    return ok, score


def check_figures(figs: DataFrame, facts: DataFrame, doc: str, min_score: int = 0) -> DataFrame:
    """Status of every figure against the facts of its document: verified, calculated or not_found.

    ``figs`` needs (fig_id, doc, value, unit, tol); ``facts`` (doc, parent, number). Both may carry the arrays ``stations``, ``times`` and ``words`` of
    their context: a fact about other stations or times doesn't count, and the score of the rest must reach ``min_score``.
    A figure is verified if a fact lies within its tolerance, and calculated if it is the difference, the ratio or the percentage between two facts of
    one parent. Parents with many facts need no pairs of them: with a figure and one fact, the other fact lies in a known interval, which meets the facts in an
    equi-join on log-scaled buckets between the parent's least and greatest fact. Up to ``FEW_FACTS`` facts are fewer than an interval's buckets
    and paired.
    """
    extra = [c for c in ("stations", "times", "words") if c in facts.columns]
    num = facts.select(doc, "parent", F.abs("number").alias("x"), *[F.col(c).alias(f"_{c}") for c in extra]).filter("x IS NOT NULL")
    group = Window.partitionBy(doc, "parent")
    num = num.distinct().withColumn("_b", _bucket(F.col("x"))).withColumns({"_n": F.count(F.lit(1)).over(group), "_lo": F.min("x").over(group), "_hi": F.max("x").over(group)})
    num = cut(num)
    ok, score = _context_score(tuple(figs.columns), tuple(facts.columns))
    r = readings(figs)
    c, tol = F.col("cand"), F.col("ctol")
    hit = _in_buckets(r, c - tol, c + tol).join(num, [doc, "_b"]).filter((F.abs(F.col("x") - c) <= tol + 1e-9) & ok & (score >= min_score))
    hit = hit.drop("_n", "_lo", "_hi")
    found = hit.select(doc, "fig_id").distinct().withColumn("status", F.lit("verified"))
    rest = r.join(found.select(doc, "fig_id"), [doc, "fig_id"], "left_anti")
    one = rest.join(num.drop("_b"), doc).filter(ok & (score >= min_score)).drop(*[f"_{n}" for n in extra])
    x = F.col("x")
    over = lambda v: F.when(v > 1e-12, x / v).otherwise(F.lit(_BEYOND))
    up, down, part = (c + tol) / 100, (c - tol) / 100, lambda lo, hi: F.struct((lo - 1e-6).alias("lo"), (hi + 1e-6).alias("hi"))
    spans = F.array(part(x - c - tol, x - c + tol), part(x + c - tol, x + c + tol), part(over(c + tol), over(c - tol)), part(over(1 + up), over(1 + down)), part(over(1 - down), over(1 - up)))
    cols = [doc, "fig_id", "parent", "x", "cand", "ctol"]
    other = num.select(doc, "parent", F.col("x").alias("y"), "_b", "_n").distinct()
    many = one.filter(F.col("_n") > FEW_FACTS).select(*cols, "_lo", "_hi", F.explode(spans).alias("_s")).filter("_s.hi >= _lo AND _s.lo <= _hi")
    many = _in_buckets(many, F.greatest("_s.lo", "_lo"), F.least("_s.hi", "_hi")).select(*cols, "_b").distinct().join(other.filter(F.col("_n") > FEW_FACTS).drop("_n"), [doc, "parent", "_b"]).drop("_b")
    few = one.filter(F.col("_n") <= FEW_FACTS).select(*cols).join(other.filter(F.col("_n") <= FEW_FACTS).drop("_b", "_n"), [doc, "parent"])
    j = few.unionByName(many).filter("x <> y")
    near = lambda v: F.coalesce(F.abs(v - c) <= tol + 1e-9, F.lit(False))
    y = F.col("y")
    calc = j.filter(near(F.abs(x - y)) | near(F.try_divide(x, y)) | near(F.abs(F.try_divide(x, y) - 1) * 100))
    s = found.unionByName(calc.select(doc, "fig_id").distinct().withColumn("status", F.lit("calculated")))
    return figs.join(s, [doc, "fig_id"], "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def consistency(figs: DataFrame, group: str, run: str) -> DataFrame:
    """Figures shared by all runs of a group, figures in any, and the share that is identical."""
    v = figs.select(group, run, F.concat_ws(":", "kind", F.round("value", 6).cast("string")).alias("f")).distinct()
    runs = v.select(group, run).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("runs"))
    per = v.groupBy(group, "f").agg(F.count(F.lit(1)).alias("n")).join(runs, group)
    g = per.groupBy(group, "runs").agg(F.count_if(F.col("n") == F.col("runs")).alias("in_common"), F.count(F.lit(1)).alias("in_any"))
    return g.withColumn("share_identical", F.col("in_common") / F.col("in_any"))
