"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions and MLlib only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, null_safe

#: a candidate: a run of such characters with a digit in it
CANDIDATE = r"[A-Za-z0-9_+/=.\-]{16,}"
#: a value assigned to a credential name is a candidate too, whatever its characters, length and quotes
_NAME = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api_?key|key|credentials?|auth(?:orization)?)[a-z0-9_.\-]*[\"'`\])]*"
_OPEN, _VALUE = r"[\"'`(\[{<]*", r"([^\x09-\x0D\x20\"'`]+)"
INLINE = rf"(?i){_NAME}(?::=|[:=])+{_OPEN}{_VALUE}"
BEFORE = rf"{_NAME}(?::=|[:=])+[\"'`]?$"
#: formats of keys, and passwords in addresses, that need no words beside them
FORMATS = (
    r"((?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}"
    r"|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+)"
)
ADDRESS = r"[a-z]://[^/:@\x09-\x0D\x20]*:([^@/\x09-\x0D\x20]+)@"
#: texts without any of these have no candidates
_ANY = rf"(?i){_NAME}[\x09-\x0D\x20]*[:=]|(?:bearer|basic)[\x09-\x0D\x20]|://[^/@\x09-\x0D\x20]*:"
#: placeholders and references to a value that is elsewhere
PLACEHOLDER = r"example|dummy|placeholder|changeme|your[_\-]|xxxx|0000|1234567|^[$<%{]|^(none|null|nil|true|false|undefined|bearer|basic|token|password|secret|key)$"
#: characters that end a token
BLANKS = r"[\x09-\x0D\x20]+"
#: words beside a secret, and words beside harmless identifiers
ASSIGNED = ("token", "secret", "password", "passwd", "apikey", "api", "key", "credential", "auth", "bearer")
HARMLESS = ("sha", "sha1", "sha256", "md5", "commit", "uuid", "guid", "hash", "digest", "checksum", "example")
#: most candidates that are fitted on; words of the dictionary and characters of the pieces that are looked up
MOST_FINDINGS = 20_000
DICTIONARY = 20_000
PIECE = 4
THRESHOLD = 0.5
FEATURES = (
    "chars", "digits", "lower", "upper", "other", "hex", "distinct", "class_changes", "vowel_pairs", "digit_runs", "repeats",
    "coverage", "assigned", "harmless", "quoted", "equals", "path_depth", "path_test",
)


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, path, place (number of the token), nth (within the token), value, before, earlier, after, token.

    ``path`` is a column of ``docs`` or null. Null texts have no candidates.
    """
    path = F.col("path").cast("string") if "path" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(FORMATS) | F.col("text").rlike(_ANY)).select("doc_id", path.alias("path"), F.split("text", BLANKS).alias("tokens"))
    tokens = F.col("tokens")
    near = F.transform(
        tokens,
        lambda t, i: F.struct(
            i.alias("place"), t.alias("token"),
            F.lower(F.coalesce(F.get(tokens, i - 1), F.lit(""))).alias("before"),
            F.lower(F.coalesce(F.get(tokens, i - 2), F.lit(""))).alias("earlier"),
            F.lower(F.coalesce(F.get(tokens, i + 1), F.lit(""))).alias("after"),
        ),
    )
    pattern = lambda x: x["token"].rlike(CANDIDATE) & x["token"].rlike("[0-9]")
    other = lambda x: x["token"].rlike(INLINE) | x["token"].rlike(FORMATS) | x["token"].rlike(ADDRESS) | _assigned_before(x["before"], x["earlier"])
    hits = rows.select("doc_id", "path", F.explode(F.filter(near, lambda x: pattern(x) | other(x))).alias("t")).select("doc_id", "path", "t.*")
    all_of = lambda regex: F.regexp_extract_all("token", F.lit(regex), F.lit(1))
    bare = F.regexp_extract("token", "^" + _OPEN + _VALUE, 1)
    values = F.regexp_extract_all("token", F.lit(CANDIDATE), F.lit(0))
    extra = F.concat(all_of(FORMATS), all_of(INLINE), all_of(ADDRESS), F.when(_assigned_before(F.col("before"), F.col("earlier")), F.array(bare)).otherwise(F.array()))
    trimmed = F.transform(extra, lambda v: F.regexp_replace(v, r"[,;.)\]}>]+$", ""))
    named = F.filter(values, lambda v: v.rlike("[0-9]"))
    hits = hits.withColumn("extra", F.filter(F.array_except(F.array_distinct(trimmed), named), lambda v: F.length(v) > 0))
    found = F.posexplode(F.concat(F.transform(values, lambda v: F.when(v.rlike("[0-9]"), v)), "extra")).alias("nth", "value")
    return hits.select(*[c for c in hits.columns if c != "extra"], found).where("value is not null")


def _assigned_before(before: Column, earlier: Column) -> Column:
    """The tokens in front assign to a credential name, or are a bearer header."""
    split = before.rlike("^(:=|=|:)$") & earlier.rlike(_NAME + "$")
    header = before.rlike("(^|[^a-z])(bearer|basic)$") & earlier.rlike("authorization")
    return before.rlike(BEFORE) | split | header


def dictionary(docs: DataFrame, words: int = DICTIONARY) -> DataFrame:
    """The ``PIECE``-letter pieces of the ``words`` most frequent words of all texts (ties by the word): at most a bounded number of rows."""
    seen = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where(F.length("word") >= PIECE)
    top = seen.groupBy("word").count().orderBy(F.desc("count"), "word").limit(words)
    pieces = F.transform(F.sequence(F.lit(1), F.length("word") - PIECE + 1), lambda i: F.substring(F.col("word"), i, PIECE))
    return top.select(F.explode(pieces).alias("piece")).distinct()


def _beside(names: tuple[str, ...]) -> Column:
    pattern = r"(^|[^a-z])(" + "|".join(names) + r")([^a-z]|$)"
    return (F.col("before").rlike(pattern) | F.col("earlier").rlike(pattern) | F.lower("head").rlike(pattern)).cast("double")


def features(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """Add the ``FEATURES``: length, kinds of characters and their transitions, share of ``pieces`` in the value, path and neighbours."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    found = found.withColumn("head", F.expr("substring(token, 1, instr(token, value) - 1)"))
    values = found.select("value").distinct()
    count = F.length("value") - PIECE + 1
    cells = values.where(count > 0).select("value", count.alias("n"), F.explode(F.sequence(F.lit(1), count)).alias("i")).withColumn("piece", F.lower(F.expr(f"substring(value, i, {PIECE})")))
    covered = cells.join(F.broadcast(pieces.withColumn("known", F.lit(1))), "piece", "left")
    covered = covered.groupBy("value").agg((F.count("known") / F.first("n")).alias("coverage"))
    found = found.join(covered, "value", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))  # shorter values have no pieces
    path = F.lower(F.coalesce("path", F.lit("")))
    made = {
        "chars": n, "digits": share("[0-9]"), "lower": share("[a-z]"), "upper": share("[A-Z]"), "other": share("[^A-Za-z0-9]"),
        "hex": v.rlike("^[0-9a-fA-F]+$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "class_changes": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"),
        "vowel_pairs": share("[aeiouAEIOU](?=[b-df-hj-np-tv-z])"),
        "digit_runs": share("[0-9](?=[0-9])"),
        "repeats": share(r"(.)(?=\1)"),
        "assigned": _beside(ASSIGNED), "harmless": _beside(HARMLESS),
        "quoted": F.col("head").rlike("[\"'`]$").cast("double"),
        "equals": (F.col("before").rlike("[=:]$") | F.col("head").rlike("[=:][\"'`]?$")).cast("double"),
        "path_depth": (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("double"),
        "path_test": path.rlike("test|example|fixture|doc").cast("double"),
    }
    return found.withColumns({k: c.cast("double") for k, c in made.items()}).withColumn("coverage", F.col("coverage").cast("double"))


def label_findings(found: DataFrame) -> DataFrame:
    """Labels where no reviewed ones are given, from signals that are not features: 1 key formats, 0 placeholders and Luhn sums, else null."""
    v = F.col("value")
    uuid = v.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    label = F.when(F.lower("value").rlike(PLACEHOLDER) | uuid | (v.rlike("^[0-9]{13,19}$") & F.expr("luhn_check(value)")), 0.0).when(v.rlike(FORMATS), 1.0)
    return found.withColumn("label", label)


#: lines of known label; ~ is a random value. They teach what the given documents do not show: values without quotes, short and in headers
SECRET_LINES = (
    "token = \"~\" and", "secret: '~'", "API_KEY=~", "export DB_PASSWORD=~", "password: ~", "password = ~", "\"api_key\": \"~\",", "auth_token=~",
    "Authorization: Bearer ~", "-H \"Authorization: Bearer ~\"", "key = ~", "credential: ~", "passwd='~'",
)
HARMLESS_LINES = (
    "seen in commit ~ of", "sha256: ~", "md5 = ~", "uuid ~ was", "the file ~ is", "digest=~", "checksum: \"~\"", "hash = \"~\"", "order ~ came", "id=~", "example ~ here", "card ~ was used",
    "see https://host/path/~ for",
)
WORDS = ("none", "required", "see", "below", "public", "function", "value", "string", "optional", "always", "another", "nothing")


def example_lines(n: int = 6_000) -> DataFrame:
    """(doc_id, text, path, label): a bounded number of lines of known label, always the same ones."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    h = F.sha2(F.concat(F.lit("example"), F.col("id").cast("string")), 512)
    dense = F.translate(F.base64(F.unhex(h)), "+/=", "Ab9")
    kind, size = F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(6)), F.pmod(F.xxhash64("id", F.lit("size")), F.lit(34)).cast("int") + 6
    short = F.concat(F.substring(dense, 3, 4), F.substring(F.lit("!#%&*?!#"), F.pmod(F.xxhash64("id"), F.lit(8)).cast("int") + 1, 1), F.substring(dense, 9, 5))
    letters = F.translate(F.substring(dense, 1, 24), "0123456789", "qwzxkvjbpf")
    digits = F.substring(F.regexp_replace(h, "[a-f]", ""), 1, 16)
    random = F.when(kind <= 1, F.substring(h, 1, 40)).when(kind == 2, F.substring(dense, F.lit(1), size)).when(kind == 3, short).when(kind == 4, F.substring(letters, F.lit(1), size)).otherwise(F.substring(h, F.lit(1), size))
    pick = lambda names, salt: F.get(F.array(*map(F.lit, names)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(names))).cast("int"))
    part = F.col("id") % 4
    # every other row is secret; words assigned to the same names are not
    line = F.when(part <= 1, F.replace(pick(SECRET_LINES, "s"), F.lit("~"), random)).when(part == 2, F.replace(pick(HARMLESS_LINES, "h"), F.lit("~"), F.when(kind == 3, digits).otherwise(random)))
    line = line.otherwise(F.replace(pick(SECRET_LINES, "w"), F.lit("~"), pick(WORDS, "v")))
    rows = spark.range(0, n, 1, 2)
    return rows.select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), line, F.lit(" and more words")).alias("text"), F.lit("").alias("path"), (part <= 1).cast("double").alias("label"))


def train(labelled: DataFrame, most: int = MOST_FINDINGS, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest of 24 trees on at most ``most`` labelled candidates, chosen by a hash; None where both labels do not occur."""
    sample = labelled.where(F.col("label").isNotNull()).select(*FEATURES, "label", F.xxhash64("value", "doc_id", "place").alias("h"))
    sample = cut(sample.orderBy("h", *FEATURES, "label").limit(most))
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.repartition(1).sortWithinPartitions("h", *FEATURES))
    return RandomForestClassifier(numTrees=24, maxDepth=6, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed).fit(rows)


def secret_scan(docs: DataFrame, labels: DataFrame | None = None, most: int = MOST_FINDINGS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, place, nth, value, score, secret (score >= threshold), with the ``FEATURES``.

    Candidates are runs of ``CANDIDATE`` with a digit, values assigned to a credential name or behind a bearer header whatever their length, characters
    and quotes, known key formats and passwords in addresses. ``labels`` are reviewed findings (doc_id, place, nth, label 0/1). Without them
    ``example_lines`` and ``label_findings`` teach, and key formats and passwords in addresses have score 1 unless they are placeholders. The forest is fitted on a bounded
    sample; every candidate of every whole text is scored. Without both labels every candidate is kept with score 1, as
    nothing is known that would rule it out. Null and empty texts give no rows; repeated rows give repeated candidates; a column
    ``path`` is used if there is one, other columns are ignored.
    """
    pieces = cut(dictionary(docs))
    found = cut(features(candidates(docs), pieces))
    if labels is None:
        lines = example_lines()
        known = features(candidates(lines), pieces).join(lines.select("doc_id", "label"), "doc_id")
        columns = [*FEATURES, "label", "value", "doc_id", "place"]
        labelled = known.select(*columns).unionByName(label_findings(found).where("label is not null").withColumn("doc_id", F.xxhash64("doc_id")).orderBy(F.xxhash64("value", "doc_id", "place"), *FEATURES).limit(2_000).select(*columns))
    else:
        keys = ["doc_id", "place", "nth"]
        labelled = null_safe(found, labels.groupBy(*keys).agg(F.max("label").cast("double").alias("label")), keys)
    model = train(labelled, most)
    if model is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    if labels is None:
        clear = F.col("value").rlike("^" + FORMATS) | (F.col("head").rlike("[a-z]://[^/:@]*:$") & F.expr("instr(token, concat(value, '@')) > 0"))
        scored = scored.withColumn("score", F.when(clear & ~F.lower("value").rlike(PLACEHOLDER), 1.0).otherwise(F.col("score")))
    return scored.withColumn("secret", F.col("score") >= threshold).select("doc_id", "place", "nth", "value", "score", "secret", *FEATURES)
