"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Candidates are values assigned to a secret's keyword, whatever they are (quoted to the closing quote, else to a space or the next separator),
and runs of 16 or more key-like characters with a digit, which end at ``=`` unless it is padding at their end.  The forest reads length, character classes and transitions
between them, share of characters in dictionary fragments, whether the candidate looks like part of a path, and the
words around it.  It is trained on labelled findings (a table of before, candidate, after, label); without such a table a fixed set
of made-up texts is used, cut by the scan's own pattern; a documented bound of the classifier's fit.  Every whole text is scanned.

Defined cases: null and empty texts have no candidates; rows with the same id are scanned one by one; a null id stays null in the
result; an empty table gives an empty result; other columns pass through ``redact`` unchanged.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import fresh

KEY = r"A-Za-z0-9_+/\-"
# Names that a secret's value is assigned to.
NAMES = "token|secret|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|password|passwd|pwd|passphrase|credentials?"
# The cheap look-behinds come first: the name is looked for only behind an assignment.
ASSIGNED = rf"""(?<=[=:>\s"'])(?<=[=:]>?[ \t]{{0,3}}["']?)(?<=(?i:{NAMES})["']?[ \t]{{0,3}}(?:=>|:=|[=:])[ \t]{{0,3}}["']?)"""
QUOTED = r"""(?<=")[^"\r\n]{4,}+(?=")|(?<=')[^'\r\n]{4,}+(?=')"""
BARE = r"""(?<!["'])[^\s"'&;,<>=:][^\s"'&;,<>]{3,}+"""
CANDIDATE = rf"{ASSIGNED}(?:{QUOTED}|{BARE})|(?<![{KEY}])(?=[A-Za-z_+/\-]*[0-9])[{KEY}]{{16,}}+(?:={{1,2}}(?![{KEY}=]))?"
#: Characters of context on either side.
CONTEXT = 48
MARK = "[SECRET]"
# Words beside a secret, words beside a harmless value, and dictionary fragments.
NEAR_SECRET = "token|secret|api_?key|apikey|access_?key|password|passwd|pwd|auth|bearer|credential|private_?key|client_?secret"
NEAR_HARMLESS = "commit|sha\\d*|md5|hash|checksum|digest|uuid|guid|etag|revision|version|build|example|sample|test|dummy|order|phone|card|call|isbn|id"
FRAGMENTS = "the|and|ing|ion|ent|for|ver|ter|con|pro|com|per|int|est|all|file|name|data|page|image|user|time|date|index|test|main|home|example|placeholder|changeme|your|here|xxxx|abcd|1234|0000"
# Values that stand for a secret or name its kind.
BLANK = "^(none|null|nil|true|false|undefined|string|str|text|bytes|int|required|optional|empty|unknown|hidden|redacted|removed|invalid|missing|expired|bearer|basic|field|value|input|the|this|that|your|must|never|please)\\b|^<|>$|placeholder|change_?me|example|your[_-]|_here|xxxx|^\\W+$"
FEATURES = ("length", "digits", "lowers", "uppers", "symbols", "distinct", "class_steps", "case_steps", "repeats", "hex", "covered", "vowels", "slashes", "path", "known", "near_secret", "near_harmless", "assigned", "quoted", "blank", "named", "code")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """``found`` (before, candidate, after) with the columns of FEATURES."""
    x, before, after = F.col("candidate"), F.lower("before"), F.lower("after")
    n = F.length(x).cast("double")
    near = F.concat_ws(" ", F.regexp_extract(before, r"(\S*\s*\S*\s*\S*)$", 1), F.regexp_extract(after, r"^\S*\s*(\S*)", 1))
    flag = lambda c: c.cast("int").cast("double")
    return found.withColumns({
        "length": n,
        "digits": _count(x, "[0-9]") / n,
        "lowers": _count(x, "[a-z]") / n,
        "uppers": _count(x, "[A-Z]") / n,
        "symbols": _count(x, r"[^A-Za-z0-9]") / n,
        "distinct": F.size(F.array_distinct(F.split(x, "(?!^)"))).cast("double") / n,
        "class_steps": _count(x, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "case_steps": _count(x, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "repeats": _count(x, r"(.)(?=\1)") / n,
        "hex": flag(x.rlike("^[0-9a-fA-F]+$")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(x), FRAGMENTS, "")) / n,
        "vowels": _count(F.lower(x), "[aeiou]") / n,
        "slashes": _count(x, "/") / n,
        "path": flag(x.rlike(r"/[a-z0-9_\-]{2,}/") | before.rlike(r"(://\S*|[./\\])$") | after.rlike(r"^\.(html?|png|jpe?g|gif|js|css|py|java|txt|pdf|com|org|net)\b")),
        "known": flag(x.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk_live_\w+|xox[abp]-|AIza[0-9A-Za-z_\-]{35}|glpat-)")),
        "near_secret": flag(near.rlike(NEAR_SECRET)),
        "near_harmless": flag(near.rlike(rf"\b({NEAR_HARMLESS})\b")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        "blank": flag(F.lower(x).rlike(BLANK)),
        "named": flag(before.rlike(rf"({NAMES})[\"']?\s*(=>|:=|[=:])\s*[\"']?$")),
        "code": flag(x.rlike(r"^(\$|%|\*|\{|\(|\[|\.)|\(|\$\{|\{\{|\[.*\]|\*{3}|^[a-z_]+(\.[a-z_]+)+$")),
    })


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Made-up findings with labels: keys in assignments and headers against hashes, ids, numbers, paths and placeholders."""
    h = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 512)
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(values))) + 1).cast("int"))
    base = F.base64(F.unhex(h("b")))
    word = lambda k: pick(k, ["paper", "garden", "index", "river", "summer", "window", "table", "simple", "report", "market"])
    secret = F.element_at(F.array(
        F.substring(h("s"), 1, 40), F.substring(h("s"), 1, 32), F.regexp_replace(F.substring(base, 1, 40), "[+/]", "7"), F.concat(F.lit("AKIA"), F.upper(F.substring(h("s"), 1, 16))),
        F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(base, "[+/]", "x"), 1, 36)), F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(base, "[+/]", "k"), 1, 24)),
    ), (F.pmod(F.xxhash64(F.lit("t"), "id"), F.lit(6)) + 1).cast("int"))
    harmless = F.element_at(F.array(
        F.substring(h("f"), 1, 40), F.substring(h("f"), 1, 32), F.concat_ws("-", F.substring(h("f"), 1, 8), F.substring(h("f"), 9, 4), F.substring(h("f"), 13, 4), F.substring(h("f"), 17, 4), F.substring(h("f"), 21, 12)),
        F.lpad(F.conv(F.substring(h("f"), 1, 13), 16, 10), 16, "4"), F.concat_ws("/", F.lit("/usr"), word("p"), word("q"), F.lit("v2"), F.lit("index")), F.concat_ws("_", word("p"), word("q"), word("r"), F.lit("2024")),
        F.concat(F.lit("your_api_key_here_"), F.lit("12345")), F.concat(F.lit("EXAMPLE0000"), F.lit("KEYKEYKEY")), F.concat_ws("-", F.lit("2024-05-17T10-22-33"), word("p")), F.concat(F.lit("+49170"), F.lpad(F.conv(F.substring(h("f"), 1, 9), 16, 10), 11, "1")),
    ), (F.pmod(F.xxhash64(F.lit("u"), "id"), F.lit(10)) + 1).cast("int"))
    good_before = pick("gb", ['token = "', "api_key: ", 'secret="', "password = '", "Authorization: Bearer ", "export ACCESS_KEY=", 'const apiKey = "', "client_secret=", 'words before token = "', "passwd ", "GITHUB_TOKEN=", "https://example.com/x?token=", "a line\nAWS_SECRET_ACCESS_KEY="])
    good_after = pick("ga", ['"', "", '" more words', "'", "\n", '";', "&x=1", '" )', '"### more', "'"])
    bad_before = pick("bb", ["commit ", "sha1 checksum ", "the order ", "call me at ", "see ", "https://example.com/", "with card ", "md5: ", "request id ", "some words before ", "id=", "version=", "page?ref=", 'checksum = "', "etag: "])
    bad_after = pick("ba", ["", " and more", ".", ".html", " words", "\n", ", then", ")", " of", " was", "&x=1"])
    # keys that are known by their form alone, and assigned values that are no keys
    own = F.element_at(F.array(
        F.concat(F.lit("AKIA"), F.upper(F.substring(h("s"), 1, 16))), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(base, "[+/]", "x"), 1, 36)), F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(base, "[+/]", "k"), 1, 24)), F.concat(F.lit("ghp_"), F.substring(h("g"), 1, 36)),
    ), (F.pmod(F.xxhash64(F.lit("o"), "id"), F.lit(4)) + 1).cast("int"))
    plain_before = pick("pb", ["", "words before ", "some text\n", "it was ", "(", "see ", "the key is ", "and then "])
    plain_after = pick("pa", ["", " and more", ".", "\n", ")", ", then", " was"])
    word2 = pick("w2", ["hunter", "dragon", "monkey", "Sommer", "letmein", "correct", "Tr0ub4dor", "football", "qwerty", "sunshine"])
    short = F.element_at(F.array(
        F.concat(word2, F.substring(h("n"), 1, 2)), F.concat(word2, F.lit("!"), F.substring(h("n"), 1, 3)), word2, F.substring(base, 1, 10), F.concat(F.initcap(word("p")), F.lit("@"), F.initcap(word("q")), F.lit("9")), F.concat_ws("-", word("p"), word("q"), word2),
    ), (F.pmod(F.xxhash64(F.lit("v"), "id"), F.lit(6)) + 1).cast("int"))
    phrase = F.concat_ws(" ", word("p"), word2, word("q"), word("r"))
    name = pick("nm", ["password", "passwd", "DB_PASSWORD", "secret", "pwd", "client_secret", "access_token", "api_key", "passphrase", "apiKey"])
    blank = pick("bl", ["none", "null", "your_password_here", "string", "required", "${DB_PASSWORD}", "os.environ", "get_token()", "<password>", "changeme", "********", "placeholder", "true", "config.password", "undefined", "{{ secret }}", "the", "never", "optional", "EXAMPLE_VALUE"])
    bare, quote = F.concat(name, pick("as", ["=", ": ", " = ", ":"])), pick("q", ['"', "'"])
    kind, bad = F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(10)), F.pmod(F.col("id"), F.lit(2)) == 0
    # a made-up placeholder stays harmless even in an assignment
    holder = harmless.startswith("your_") | harmless.startswith("EXAMPLE")
    some = lambda good, ill: F.when(bad, ill).otherwise(good)
    made = spark.range(n).select(
        F.when(kind < 5, some(good_before, F.when(holder, good_before).otherwise(bad_before))).when(kind < 7, some(plain_before, bad_before)).when(kind == 7, F.concat(bare, quote)).otherwise(bare).alias("b"),
        F.when(kind < 5, some(secret, harmless)).when(kind < 7, some(own, harmless)).when(kind == 7, some(phrase, blank)).otherwise(some(short, blank)).alias("value"),
        F.when(kind < 5, some(good_after, bad_after)).when(kind < 7, some(plain_after, bad_after)).when(kind == 7, quote).otherwise(pick("sa", ["", "\n", "&x=1", " ", "; then"])).alias("a"),
        F.when(bad, 0.0).otherwise(1.0).alias("label"),
    )
    # what the scan cuts out of the made-up texts; only the part that is the value is a secret
    found = _found(made.select("b", "value", "label", F.concat("b", "value", "a").alias("text")), "text", ["b", "value", "label"])
    inside = (F.col("start") > F.length("b")) & (F.col("start") <= F.length("b") + F.length("value"))
    return found.select("before", "candidate", "after", F.when(inside, F.col("label")).otherwise(0.0).alias("label"))


def train(labelled: DataFrame, trees: int = 20, depth: int = 6) -> PipelineModel:
    rows = with_features(labelled.select("before", "candidate", "after", F.col("label").cast("double").alias("label")).na.drop()).select("label", *FEATURES)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, cacheNodeIds=False).fit(assembler.transform(rows.coalesce(2)))
    return PipelineModel([assembler, forest])


#: Candidates whose lengths are summed at once, so that positions of many candidates take few steps.
_STEP = 256


def _before(lengths: Column) -> Column:
    """Of an array of numbers, the sum of those before each."""
    some = lambda k: F.slice(lengths, k * _STEP + 1, _STEP)
    zero = F.lit(0).cast("long")
    blocks = F.sequence(F.lit(0), F.ceil(F.size(lengths) / _STEP).cast("int") - 1)

    def running(x: Column, start: Column) -> Column:
        state = F.aggregate(x, F.struct(F.array().cast("array<bigint>").alias("a"), start.alias("s")), lambda acc, y: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + y).alias("s")))
        return state["a"]

    heads = running(F.transform(blocks, lambda k: F.aggregate(some(k), zero, lambda acc, y: acc + y)), zero)
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("k"), heads.alias("h")), lambda b: running(some(b["k"]), b["h"])))


def _found(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per candidate: the columns ``keep``, and no (its number in the text), start, before, candidate, after.

    All that a candidate needs is cut out before the rows are made, so a row holds its own surroundings and never the text.
    """
    p, c, n, at, one = (F.col(x) for x in ("_pieces", "_cands", "_lengths", "_at", "_one"))
    rows = docs.where(F.col(text).rlike(CANDIDATE)).select(*keep, F.split(F.col(text), CANDIDATE, -1).alias("_pieces"), F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), 0).alias("_cands"))
    rows = rows.withColumn("_lengths", F.transform(c, lambda x, i: (F.length(F.get(p, i)) + F.length(x)).cast("long"))).withColumn("_at", _before(n))
    one_each = F.transform(c, lambda x, i: F.struct(
        i.alias("no"), (F.get(at, i) + F.length(F.get(p, i)) + 1).alias("start"), F.substring(F.get(p, i), -CONTEXT, CONTEXT).alias("before"), x.alias("candidate"), F.substring(F.coalesce(F.get(p, i + 1), F.lit("")), 1, CONTEXT).alias("after"),
    ))
    return rows.select(*keep, F.explode(one_each).alias("_one")).select(*keep, *[one[x].alias(x) for x in ("no", "start", "before", "candidate", "after")])


def scan(docs: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """Every candidate of every text: doc_id, start (in characters, from 1), n_chars, secret_sha256, score, is_secret."""
    found = with_features(_found(docs.select("doc_id", "text"), "text", ["doc_id"]))
    scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("n_chars"), F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark, and ``n_chars``, where there is one, brought up to date.

    Decisions depend on the text alone, so texts are scored once each and meet their rows by two 64-bit hashes of the text;
    texts without candidates pass by the join.
    """
    cols = docs.columns
    h1, h2, nos = fresh(docs, "_h1", "_h2", "_nos")
    one, two = F.xxhash64("text"), F.xxhash64(F.lit(11), "text")
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    found = with_features(_found(docs.select("text", one.alias("_h1"), two.alias("_h2")), "text", ["_h1", "_h2"]))
    scored = model.transform(found).withColumn("_secret", vector_to_array("probability")[1] >= threshold).where("_secret")
    secret = scored.groupBy(F.col("_h1").alias(h1), F.col("_h2").alias(h2)).agg(F.collect_set("no").alias(nos))
    rows = docs.where(has).withColumns({h1: one, h2: two}).join(secret, [h1, h2], "left")
    pieces, cands = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), 0)
    parts = F.transform(F.arrays_zip(pieces.alias("p"), cands.alias("c")), lambda x, i: F.concat(x["p"], F.when(F.array_contains(nos, i), F.lit(MARK)).otherwise(F.coalesce(x["c"], F.lit("")))))
    text = F.when(F.col(nos).isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    rows = rows.withColumn("text", text)
    if "n_chars" in cols:
        kind = dict(docs.dtypes)["n_chars"]
        rows = rows.withColumn("n_chars", F.when(F.col(nos).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return rows.select(*cols).union(docs.where(~has))
