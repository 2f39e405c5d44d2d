"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are found by one regular expression.  Each gets features of its
length, character transitions, dictionary coverage, path and neighbouring
words, and a random forest that was trained on labelled findings decides.
Everything runs in the JVM: DataFrame functions and Spark's own forest.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import free_name

# Prefixes of published key formats.
PREFIXES = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|sk-|sk_live_|rk_live_|eyJ|SG\.|npm_|pypi-"
KEYWORDS = r"password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential"
#: The value of an assignment to a keyword (of any case, in quotes or brackets or not), or a long run with a digit, or a run behind a known prefix; however long.
CANDIDATE = (
    rf"(?<![A-Za-z0-9_.+/-])(?:{PREFIXES})[A-Za-z0-9_.+/=-]{{12,}}+"
    rf"|(?<=(?i:{KEYWORDS})[\"'\])]{{0,2}}\s{{0,3}}[:=]\s{{0,3}}[\"']?)[^\s\"',;]{{8,}}+"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}"
)
#: What a text with a candidate must hold: a digit, a known prefix or a keyword.  Far cheaper than the pattern.
MAY = ("[0-9]", rf"{PREFIXES}|(?i:{KEYWORDS})")
#: Characters of context on either side.
CONTEXT = 48
# Words that placeholders and identifiers are made of.
DICTIONARY = (
    "the and for with this that from have your test example sample dummy fake demo changeme placeholder default value string name "
    "user admin root local host server client config setting data base table index key secret token password pass word login account "
    "file path folder image version release build commit branch hash check sum digest uuid guid trace span session request response "
    "content type message error page line column number count size time date year month day hour total amount price order item product "
    "customer section chapter figure note test tests spec mock fixture foo bar baz lorem ipsum one two three four five six seven eight nine ten"
).split()
HASH_WORDS = r"(?i)(sha-?\d*|md5|checksum|digest|commit|revision|etag|uuid|guid|hash|fingerprint|isbn|trace|build)\W*(\w+\W+)?$"
PLACE_PATHS = r"(?i)(^|[/_.-])(tests?|specs?|examples?|samples?|fixtures?|mocks?|docs?)([/_.-]|$)"
FEATURES = ["length", "digits", "uppers", "transitions", "coverage", "distinct", "vowels", "hex", "prefix", "keyword", "hash_word", "place_path", "placeholder"]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, start (from 0), value, before, after for every place that the pattern matches.

    Only texts that match are taken apart; start is a running sum of small
    numbers within a text, so a text with very many candidates is no burden.
    """
    pattern = F.lit(CANDIDATE)
    rows = docs.select("doc_id", (F.col(path) if path in docs.columns else F.lit(None)).cast("string").alias("path"), "text")
    may = F.col("text").rlike(MAY[0]) | F.col("text").rlike(MAY[1])
    rows = rows.filter(F.when(may, F.col("text").rlike(CANDIDATE)).otherwise(F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("found", F.regexp_extract_all("text", pattern, F.lit(0))).withColumn("between", F.split("text", CANDIDATE, -1))
    each = F.transform(
        "found",
        lambda v, i: F.struct(v.alias("value"), F.length(F.col("between")[i]).alias("gap"), F.right(F.col("between")[i], F.lit(CONTEXT)).alias("before"), F.left(F.col("between")[i + 1], F.lit(CONTEXT)).alias("after")),
    )
    flat = rows.select("doc_id", "path", "row", F.posexplode(each).alias("pos", "c")).select("doc_id", "path", "row", "pos", "c.*")
    order = "PARTITION BY row ORDER BY pos"
    start = F.expr(f"sum(gap + length(value)) OVER ({order}) - length(value)")
    return flat.select("doc_id", "path", start.cast("long").alias("start"), "value", "before", "after")


def features(found: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES, all doubles between 0 and 1 but length."""
    v, low = F.col("value"), F.lower("value")
    n = F.length(v).cast("double")
    letters = F.regexp_count(low, F.lit("[a-z]"))
    words = F.lit("|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made: dict[str, Column] = {
        "length": n,
        "digits": F.regexp_count(v, F.lit("[0-9]")) / n,
        "uppers": F.regexp_count(v, F.lit("[A-Z]")) / n,
        "transitions": F.regexp_count(v, F.lit("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])")) / n,
        "coverage": F.lit(1.0) - F.length(F.regexp_replace(low, words, F.lit(""))) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "vowels": F.when(letters > 0, F.regexp_count(low, F.lit("[aeiou]")) / letters).otherwise(0.0),
        "hex": flag(v.rlike("^[0-9a-fA-F]+$")),
        "prefix": flag(v.rlike(f"^(?:{PREFIXES})")),
        "keyword": flag(F.col("before").rlike(rf"(?i)(?:{KEYWORDS})\W{{0,6}}(?:\w+\W+)?$")),
        "hash_word": flag(F.col("before").rlike(HASH_WORDS)),
        "place_path": flag(F.col("path").rlike(PLACE_PATHS)),
        "placeholder": flag(F.concat_ws(" ", F.right("before", F.lit(16)), v, F.left("after", F.lit(16))).rlike(r"(?i)example|placeholder|dummy|change.?me|your[_-]|x{6}|0{8}|1234567")),
    }
    return found.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in made.items()])


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings made from a rule: value, before, after, path, label.

    Fifteen kinds in turn, eight of them secrets; all random parts come from
    SHA-256 of the row's number.  rows bounds the size of the training set.
    """
    rand = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    hexa = lambda salt, n: F.substring(rand(salt), 1, n)
    b64 = lambda salt, n: F.regexp_replace(F.substring(F.base64(F.unhex(rand(salt))), 1, n), "[+/=]", "k")
    b32 = lambda salt, n: F.substring(F.upper(F.translate(F.conv(hexa(salt, 15), 16, 36), "01", "XQ")), 1, n)
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    word = lambda salt: pick(salt, DICTIONARY)
    prose = lambda salt: F.concat_ws(" ", word(salt + "a"), word(salt + "b"), word(salt + "c"))
    assign = F.concat(prose("p"), F.lit(" "), pick("k", ["password", "secret", "token", "api_key", "passwd", "access_key"]), pick("s", ["=", " = ", ": ", '="', ' = "', ': "']))
    number = F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(100000)).cast("string")
    plain, hashes = F.concat(prose("q"), F.lit(" ")), F.concat(prose("q"), F.lit(" "), pick("h", ["sha256 ", "md5: ", "commit ", "checksum=", "etag: ", "revision ", "uuid "]))
    long = lambda salt: F.substring(F.concat(*[b64(f"{salt}{k}", 43) for k in range(20)]), F.lit(1), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(760)) + 100).cast("int"))
    kinds = [  # (value, before, label)
        (F.concat(F.lit("AKIA"), F.rpad(b32("a", 16), 16, "Q7")), plain, 1),
        (hexa("b", 40), assign, 1),
        (hexa("c", 18), assign, 1),
        (b64("d", 32), assign, 1),
        (F.concat(pick("x", ["ghp_", "glpat-", "xoxb-", "AIza", "sk_live_", "npm_"]), b64("e", 36)), pick("y", ["use ", "key ", "export ", "= ", "header: "]), 1),
        (F.concat(b64("f", 12), pick("z", ["!", "#", "", "$", ""])), assign, 1),
        (hexa("g", 40), hashes, 0),
        (hexa("h", 64), F.when(F.col("id") % 2 == 0, hashes).otherwise(plain), 0),
        (F.concat_ws("_", word("i"), word("j"), word("k"), number), plain, 0),
        (F.concat_ws("-", word("l"), word("m"), word("n"), number), F.when(F.col("id") % 5 == 0, assign).otherwise(plain), 0),
        (F.concat(pick("o", ["your_", "EXAMPLE", "changeme", "xxxxxxxx", "dummy_", "00000000"]), word("p"), number), assign, 0),
        (F.concat_ws("-", hexa("r", 8), hexa("s", 4), hexa("t", 4), hexa("u", 4), hexa("v", 12)), F.when(F.col("id") % 2 == 0, hashes).otherwise(plain), 0),
        (F.concat(F.lit("eyJ"), long("A")), F.when(F.col("id") % 2 == 0, assign).otherwise(plain), 1),
        (F.when(F.pmod(F.xxhash64(F.lit("E"), "id"), F.lit(2)) == 0, F.concat(*[rand(f"F{k}") for k in range(8)])).otherwise(F.concat(long("B"), pick("C", ["!", "#", "", "$", ""]))), assign, 1),
        (long("D"), F.when(F.col("id") % 2 == 0, hashes).otherwise(plain), 0),
    ]
    choose = lambda k: F.element_at(F.array(*[x[k] if isinstance(x[k], Column) else F.lit(float(x[k])) for x in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    path = pick("path", ["src0", "src7", "web", "app/main", "crawl", "repo/tests/unit", "docs/example"])
    return spark.range(rows).select(choose(0).alias("value"), choose(1).alias("before"), prose("w").alias("after"), path.alias("path"), choose(2).alias("label"))


def train(labelled: DataFrame, trees: int = 30, depth: int = 7, seed: int = 7) -> PipelineModel:
    """A forest over the features of labelled findings (value, before, after, path, label 0 or 1)."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    rows = features(labelled)
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def judge(found: DataFrame, model: PipelineModel) -> DataFrame:
    """Candidates with the forest's probability of a secret."""
    judged = model.transform(features(found))
    return judged.withColumn("secret_score", vector_to_array("probability")[1])


def scan(docs: DataFrame, model: PipelineModel | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate with the forest's decision: doc_id, start, length, shown, value_sha256, secret_score, is_secret.

    shown: the first four characters.  Texts that are null or empty give no
    row; repeated rows give repeated findings; a missing path column counts
    as no path.  Without a model one is trained on labelled_findings().
    """
    model = model or train(labelled_findings(docs.sparkSession))
    judged = judge(candidates(docs, path), model)
    return judged.select(
        "doc_id", "start", F.length("value").cast("long").alias("length"), F.left("value", F.lit(4)).alias("shown"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        F.round("secret_score", 6).alias("secret_score"), (F.col("secret_score") >= threshold).alias("is_secret"),
    )


def redact(docs: DataFrame, findings: DataFrame, mask: str = "*") -> DataFrame:
    """``docs`` with every secret in ``findings`` overwritten, columns as they are.

    Rows are matched by doc_id, and a place is overwritten only where the text
    holds the value that was found there (by its digest), so other texts of one
    id stay.  mask: one character.
    """
    spots, mine = free_name(docs, "__spots"), free_name(docs, "__doc_id")
    found = findings.filter("is_secret").groupBy(F.col("doc_id").alias(mine)).agg(F.array_sort(F.collect_set(F.struct("start", "length", "value_sha256"))).alias(spots))

    def step(acc: Column, s: Column) -> Column:
        start, length = s["start"].cast("int"), s["length"].cast("int")
        held = F.sha2(F.substring(acc, start + 1, length).cast("binary"), 256) == s["value_sha256"]
        masked = F.concat(F.substring(acc, F.lit(1), start), F.repeat(F.lit(mask), length), F.substring(acc, start + length + 1, F.length(acc)))
        return F.when(held, masked).otherwise(acc)

    hidden = F.when(F.col(spots).isNull(), F.col("text")).otherwise(F.aggregate(spots, F.col("text"), step))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(mine)), "left").withColumn("text", hidden).select(docs.columns)
