r"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Every word that holds a digit or an @ is an instance. Seed entities are the instances that meet a span of the four plain
kinds (email, ip, card, phone) and those assigned to a name of secrets (``SECRETS``). Negative ones have fewer than six
letters and digits. Each instance has lexical patterns: one and two words to its left, the word to its right, the name it
is assigned to, its first four characters, and its shape (kinds of characters and the magnitude of its length). Patterns
and distinct instances form a bipartite graph. A few rounds score it: a pattern's confidence is the positive score of its
instances against the negative ones, unknown ones counting against it by ``doubt``, smoothed by ``prior``; an unknown
instance scores the noisy-or of its trusted patterns (confidence at least ``trust``). Instances that reach ``accept`` by
the end, and seed secrets, are spans of the kind ``id`` wherever they stand clear of plain spans.

Starts of matches come from the lengths of what lies between them (the pieces of a split by the same pattern), so whole
texts are scanned inside the JVM. The patterns are written without repeated groups and without restarts inside a run
(\G and look-behind), so that very long runs take neither stack nor quadratic time; they match what the plain ones
match. Positions count code points, ends are exclusive.

Defined results: null text is the empty text, with no spans and the digest of the empty string; matches that fail their
kind's test are dropped, without retries; repeated rows give a row each; spans with one start are ordered by kind; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, salted_join

KINDS = ("email", "ip", "card", "phone")
MARK, OTHER = "\ue000", "\ue001"  # one code point that stands for a joint, and what replaces it in texts
LOCAL = "A-Za-z0-9._%+-"
#: Joints are marked first: single separators between digits, dots inside names.
EMAIL = rf"(?:\G|(?<![{MARK}{LOCAL}]))[{MARK}{LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9{MARK}]{{2,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WS, WORD = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
#: Words with a digit or an @.
TOKEN = rf"(?<!{WORD})[^{WS}0-9@]*+[0-9@]{WORD}*+"
#: Names that secrets are assigned to.
SECRETS = "password|passwd|pwd|passphrase|secret|token|api_?key|access_?key|private_?key|auth_?key|client_?secret"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _clean(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)


def _found(text: Column, pattern: str) -> Column:
    """array<struct<gap, hit>>: length of the text before each match, since the one before, and the match."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(hits) > 0, F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(1))).alias("gap"), hits.alias("hit")))


def _scan(text: Column) -> dict[str, Column]:
    dots = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    joints = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    return {
        "email": F.when(F.contains(text, F.lit("@")), _found(dots, EMAIL)),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _found(text, IP)),
        "card": F.when(text.rlike(r"[0-9]"), _found(joints, CARD)),
        "phone": F.when(text.rlike(r"\+[0-9]"), _found(text, PHONE)),
    }


def _luhn(digits: Column) -> Column:
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", hit.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _placed(rows: DataFrame, column: Column, kind: Column) -> DataFrame:
    """row, kind, start, end, hit of each match, by the running lengths of gaps and matches."""
    each = rows.select("row", kind.alias("kind"), F.posexplode(column).alias("i", "m"))
    run = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap").cast("long") + F.length("m.hit")).over(run)
    return each.withColumn("end", end).select("row", "kind", (F.col("end") - F.length("m.hit")).alias("start"), "end", F.col("m.hit").alias("hit"))


def _instances(rows: DataFrame) -> DataFrame:
    """row, start, end, value, secret (boolean) and patterns of each word with a digit or an @, trimmed of punctuation and of a name before it."""
    each = rows.select("row", F.posexplode("words").alias("i", "m"))
    run = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap").cast("long") + F.length("m.hit")).over(run)
    head = F.regexp_extract("m.hit", r"^[^\p{L}\p{N}+]*+", 0)
    tail = r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
    word = F.regexp_replace(F.regexp_replace("m.hit", r"^[^\p{L}\p{N}+]*+", ""), tail, "")
    name = F.regexp_extract("word", r"""^[A-Za-z_][A-Za-z0-9_.-]*+[=:]++["']*+(?![/"'])(?=[^0-9@]*+[0-9@])""", 0)
    at = F.col("end") - F.length("m.hit") + F.length(head) + F.length("name")
    each = each.withColumn("end", end).withColumn("word", word).withColumn("name", name)
    each = each.select("row", at.alias("start"), F.expr("substr(word, length(name) + 1)").alias("value"), F.lower("name").alias("name"), F.lower("m.left").alias("left"), F.lower("m.right").alias("right"))
    each = each.where("value <> ''")
    plain = lambda c: F.regexp_replace(c, "[0-9]", "0")
    last = F.regexp_extract("left", rf"(?<!{WORD}){WORD}++$", 0)
    marks = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace("value", r"[\p{L}\p{N}]", ""), ""))), "")
    shape = F.concat(F.when(F.col("value").rlike(r"\p{L}"), "a").otherwise(""), F.when(F.col("value").rlike(r"\p{N}"), "0").otherwise(""), marks, F.lit(" "), F.floor(F.log2(F.length("value"))).cast("string"))
    pattern = lambda kind, c: F.when(c != "", F.concat(F.lit(kind + " "), c))
    patterns = F.array_compact(F.array(
        pattern("left", plain(last)), pattern("left two", F.when(F.contains(F.col("left"), F.lit(" ")), plain(F.col("left")))), pattern("right", plain(F.col("right"))),
        pattern("name", plain(F.regexp_replace("name", "[^a-z0-9_.-]", ""))), pattern("head", F.when(F.length("value") >= 12, F.left(F.lower("value"), F.lit(4)))), pattern("shape", shape),
    ))
    secret = F.concat("left", F.when(F.col("name") != "", F.lit(" ")).otherwise(F.lit("")), "name").rlike(rf"""(?:^|[^a-z0-9])(?:{SECRETS})["']*\x20?[=:]+["']*$""")
    return each.select("row", "start", (F.col("start") + F.length("value")).alias("end"), "value", secret.alias("secret"), patterns.alias("patterns"))


def _words(text: Column) -> Column:
    """Like _found, with the two words to the left of each match and the one to its right instead of all the text."""
    pieces = F.split(text, TOKEN, -1)
    hits = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    # words are only begun at their beginnings and never given back, so that long runs take linear time
    left = F.transform(pieces, lambda p: F.regexp_replace(F.regexp_extract(p, rf"(?<!{WORD})((?:{WORD}++[{WS}]++)?+{WORD}++)[{WS}]*+$", 1), rf"[{WS}]++", " "))
    right = F.transform(pieces, lambda p: F.regexp_extract(p, rf"^[{WS}]*+({WORD}++)", 1))
    n = F.greatest(F.size(hits), F.lit(1))
    return F.when(F.size(hits) > 0, F.arrays_zip(F.slice(F.transform(pieces, F.length), 1, n).alias("gap"), F.slice(left, 1, n).alias("left"), F.slice(right, 2, n).alias("right"), hits.alias("hit")))


def _seeds(inst: DataFrame, base: DataFrame) -> DataFrame:
    """``inst`` with met (boolean): whether a span of ``base`` overlaps it. Of the spans that start before its end, does the last to end reach it?"""
    order = [F.when(F.col("value").isNull(), F.col("start")).otherwise(F.col("end")), F.col("value").isNull()]  # of equals, instances first
    run = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = inst.unionByName(base.select("row", "start", "end"), allowMissingColumns=True)
    reach = F.max(F.when(F.col("value").isNull(), F.col("end"))).over(run)
    return both.withColumn("met", F.coalesce(reach > F.col("start"), F.lit(False))).where("value is not null")


def bootstrap(instances: DataFrame, rounds: int = 3, trust: float = 0.8, prior: float = 1.0, doubt: float = 0.05, accept: float = 0.8) -> DataFrame:
    """(value, score) of the instances that are no seeds and that trusted patterns find. ``instances`` has value, seed (boolean) and patterns."""
    ordinary = F.length(F.regexp_replace("value", r"[^\p{L}\p{N}]", "")) < 6
    # an instance is one value; it is a seed if any of its places is
    values = materialize(instances.groupBy("value").agg(F.max("seed").alias("seed")).withColumn("negative", ~F.col("seed") & ordinary), "values")
    edges = materialize(instances.select("value", F.explode("patterns").alias("pattern")).distinct(), "edges")
    scored = values.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        now = salted_join(edges, scored, "value", "pattern")
        against = F.when(F.col("negative"), 1.0).otherwise((1 - F.col("score")) * doubt)
        means = now.groupBy("pattern").agg((F.sum("score") / (F.sum("score") + F.sum(against) + F.lit(prior))).alias("conf"))
        trusted = materialize(means.where(F.col("conf") >= trust), "trusted")
        miss = salted_join(edges, trusted, "pattern", "value").groupBy("value").agg(F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf"))))).alias("miss"))
        score = F.when(F.col("seed"), 1.0).when(F.col("negative"), 0.0).otherwise(1 - F.coalesce("miss", F.lit(1.0)))
        scored = materialize(values.join(miss, "value", "left").select("value", "seed", "negative", score.alias("score")), "scored")
    return scored.where((F.col("score") >= accept) & ~F.col("seed")).select("value", "score")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans (of any kind); see the module."""
    text = _clean(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    scan = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    t = F.col("t")
    found = {k: c.alias(k) for k, c in _scan(t).items()}
    words = F.when(t.rlike("[0-9@]"), _words(t)).alias("words")
    rows = materialize(scan.select(F.monotonically_increasing_id().alias("row"), "doc_id", *found.values(), words), "scanned")
    base = None
    for kind in KINDS:
        got = _placed(rows.where(F.col(kind).isNotNull()), F.col(kind), F.lit(kind))
        base = got if base is None else base.unionByName(got)
    base = materialize(base.where(_valid(F.col("kind"), F.col("hit"))).drop("hit"), "base")
    inst = _seeds(_instances(rows.where("words is not null")), base).withColumn("seed", F.col("met") | F.col("secret"))
    inst = materialize(inst, "instances")
    more = bootstrap(inst, **options).select("value", F.lit(True).alias("found"))
    added = salted_join(inst.where("not met"), more, "value", "row", "left").where("secret or found").select("row", F.lit("id").alias("kind"), "start", "end")
    order = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "ip", 1).when(F.col("kind") == "card", 2).when(F.col("kind") == "phone", 3).otherwise(4)
    all_spans = base.unionByName(added).withColumn("s", F.struct("start", order.alias("o"), F.concat_ws(":", "kind", "start", "end").alias("x")))
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.filter("s", keep)), lambda x: x["x"]), ",")
    per = all_spans.groupBy("row").agg(F.collect_list("s").alias("s"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (*KINDS, "id")))
    per = per.select("row", joined(lambda x: x["o"] < 4).alias("base"), joined(lambda x: F.lit(True)).alias("spans"), F.size("s").alias("n_spans"), *(f"n_{k}" for k in (*KINDS, "id")))
    out = rows.select("row", "doc_id").join(per, "row", "left")
    zero = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(zero(k) for k in KINDS), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("id"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))


def op10_pii(spark, sf_dir):
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
