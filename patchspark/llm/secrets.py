"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

A candidate is a run of 8 or more characters of keys, tokens and passwords with at least one digit. Its features are its
length, how likely its character transitions are in words, changes between character classes, coverage by dictionary words,
hexadecimal and digit shares, the path it was found under, and the words next to it (signs of a key, and all of them hashed
to buckets). The forest is grown by pyspark.ml on a bounded number of labelled findings and compiled into one column
expression. Where no labelled findings are given, secrets and things that only look like them are planted into texts, so
that labels are known by construction and no feature decides them.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchspark.llm.mixing import uniform
from patchspark.llm.store import written
from patchspark.llm.trees import vote

#: A candidate; up to two words at the end of what stands before it; and what follows it, looked at without being taken.
CANDIDATE = r"(?<![A-Za-z0-9+/=_\-.!@#$%^&*])(?=[A-Za-z+/=_\-.!@#$%^&*]*[0-9])[A-Za-z0-9+/=_\-.!@#$%^&*]{8,}"
BEFORE, BEFORE_CHARS = r"(?:\S{1,40}\s{1,3}){0,2}\S{0,3}\z", 89
FOLLOWED = "(" + CANDIDATE + r")(?=(\S{0,3}(?:\s{1,3}\S{1,40})?))"
KEYWORDS = r"(?i)(token|secret|passw|pwd|api.?key|credential|auth|bearer|private)"
#: Characters whose transitions are told apart: letters, 0 for all digits, and one for all others.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0"
SYMBOLS = len(ALPHABET) + 1
#: Buckets of neighbouring words.
NEAR = 16
FEATURES = ["length", "changes", "transitions", "coverage", "hex", "digits", "letters", "upper", "symbols", "keyword", "own_keyword", "assigned",
            "quoted", "in_code_path", "code_after", *(f"near{i}" for i in range(NEAR))]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, n, before, candidate, after) of every candidate in whole texts; n counts from 0 in its text.

    Candidates are matched by themselves, however close they stand; before is taken from the text since the last one.
    """
    text = F.col(text_col)
    some = docs.where(text.rlike(CANDIDATE))
    candidates, after = (F.regexp_extract_all(text, F.lit(FOLLOWED), F.lit(i)) for i in (1, 2))
    parts = F.arrays_zip(F.split(text, CANDIDATE, -1).alias("before"), candidates.alias("candidate"), after.alias("after"))
    found = some.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.posexplode(parts).alias("n", "p"))
    before = F.regexp_extract(F.right("p.before", F.lit(BEFORE_CHARS)), BEFORE, 0)
    return found.where("p.candidate is not null").select(
        "doc_id", "path", "n", before.alias("before"), F.col("p.candidate").alias("candidate"), F.col("p.after").alias("after"))


def dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word) of 4 or more letters in texts, lower-cased."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}{4,}"), F.lit(0)))
    return texts.select(words.alias("word")).distinct()


def _codes(text: Column) -> Column:
    """Places in ALPHABET of the characters of text, 0 for others."""
    letters = F.split(F.translate(F.lower(text), "123456789", "0" * 9), "")
    return F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c))


def transitions(known_words: DataFrame) -> list[float]:
    """log10 of the chance of each symbol after each one in the words (add one): SYMBOLS * SYMBOLS numbers."""
    codes = known_words.select(_codes(F.concat(F.lit(" "), "word", F.lit(" "))).alias("c"))
    pairs = F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * SYMBOLS + b))
    counts = {r["pair"]: r["count"] for r in codes.select(pairs.alias("pair")).groupBy("pair").count().collect()}
    table = [[1 + counts.get(a * SYMBOLS + b, 0) for b in range(SYMBOLS)] for a in range(SYMBOLS)]
    return [math.log10(n / sum(row)) for row in table for n in row]


def with_features(found: DataFrame, known_words: DataFrame, chances: list[float] | None = None) -> DataFrame:
    """Adds FEATURES. Runs of letters in candidates meet the dictionary in an equi-join; chances: transitions(known_words)."""
    c = F.col("candidate")
    words = F.posexplode(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("at", "word")
    runs = found.select("doc_id", "n", "candidate", words).distinct()
    covered = runs.join(known_words, "word", "left_semi").groupBy("doc_id", "n", "candidate").agg(F.sum(F.length("word")).alias("covered"))
    keys = [F.col(f"f.{k}").eqNullSafe(F.col(f"w.{k}")) for k in ("doc_id", "n", "candidate")]
    joined = found.alias("f").join(covered.alias("w"), keys[0] & keys[1] & keys[2], "left").select("f.*", "w.covered")

    def count(pattern: str, of: Column = c) -> Column:
        return (F.length(of) - F.length(F.regexp_replace(of, pattern, ""))).cast("double")

    n, before, after = F.length("candidate"), F.col("before"), F.col("after")
    changes = F.size(F.regexp_extract_all(c, F.lit(r"(?=[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z])."), F.lit(0)))
    table, codes = F.lit(chances or transitions(known_words)), _codes(c)
    steps = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: F.element_at(table, (a * SYMBOLS + b + 1).cast("int")))
    likely = F.aggregate(steps, F.lit(0.0), lambda total, x: total + x) / (n - 1)
    neighbours = F.regexp_extract_all(F.lower(F.concat_ws(" ", before, after)), F.lit(r"\p{L}{2,}"), F.lit(0))
    near = F.transform(neighbours, lambda w: F.crc32(w) % NEAR)
    flag = lambda of, pattern: F.coalesce(of, F.lit("")).rlike(pattern).cast("int")
    values = [n, changes / n, likely, F.coalesce("covered", F.lit(0)) / n, count("[0-9a-fA-F]+") / n, count("[0-9]+") / n, count("[A-Za-z]+") / n, count("[A-Z]+") / n,
              count("[^A-Za-z0-9]+") / n, flag(before, KEYWORDS), flag(c, KEYWORDS), flag(before, r"[=:]\s*\S{0,3}$"), flag(before, "[\"'`]$"),
              flag(F.col("path"), r"(?i)(config|env|test|example|\.(py|js|ya?ml|json|ini|toml)$)"), flag(after, r"^[\"'`;,)}]"),
              *(F.size(F.filter(F.col("near"), lambda b, i=i: b == i)) for i in range(NEAR))]
    return joined.withColumn("near", near).select("doc_id", "path", "n", "before", "candidate", "after",
                                                  *(x.cast("double").alias(name) for name, x in zip(FEATURES, values, strict=True)))


#: How secrets and what looks like them are written: v is the value, k a name for a secret, w a word of the text.
SECRET_NAMES = ["token", "api_key", "secret", "password", "client_secret", "access_key", "credential", "private_key", "pwd", "auth"]
SECRET_PLACES = ['{k} = "{v}"', "{k}: {v}", "{k} is {v}", "{k} '{v}'", "Authorization: Bearer {v}", "set {k} to {v}", "{k} {v}"]
PLAIN_PLACES = ["commit {v}", "checksum: {v}", 'etag = "{v}"', 'id = "{v}"', "see {v}", "call {v}", "order {v}", "version {v}", "{w} {v}", '{w} = "{v}"', "{w}: {v}", "mail {v}"]


def planted(texts: DataFrame, seed: str = "plant", max_rows: int = 2500, copies: int = 4, text_col: str = "text") -> DataFrame:
    """(doc_id, source, text, value, label): texts with one secret (1) or something that looks like one (0) put in.

    At most max_rows texts are taken, by a hash, 200 characters of each, `copies` times; what is planted depends on a hash alone.
    Secrets are hexadecimal and base64 keys, keys with a prefix, tokens in three parts, and passwords, by a name for secrets.
    What only looks like them are numbers of cards and phones, digests, UUIDs, dates, files, addresses and versions by other
    words, and placeholders by a name for secrets.
    """
    h = F.col("h")
    digits = lambda first, n: F.substring(F.translate(h, "abcdef", "123456"), first, n)
    mixed = lambda first, n: F.substring(F.translate(F.base64(F.unhex(F.concat(h, F.sha2(h, 256)))), "+/=", "xyz"), first, n)
    some = lambda values, salt: F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)),
                                             (F.crc32(F.concat(h, F.lit(salt))) % len(values) + 1).cast("int"))
    w = F.lower(F.coalesce(F.nullif(F.regexp_extract("host", r"\p{L}{4,12}", 0), F.lit("")), F.lit("word")))
    hosts = texts.select(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 200).alias("host"))
    hosts = hosts.orderBy(uniform(F.col("host"), seed), "host").limit(max_rows).distinct().withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    hosts = hosts.withColumn("h", F.sha2(F.concat_ws(":", "host", F.lit(seed), "copy"), 256)).withColumn("w", w)
    secret = some([F.substring(h, 1, 40), F.substring(h, 1, 32), h, mixed(1, 32), mixed(1, 24), F.concat(F.lit("AKIA"), F.upper(mixed(1, 16))), F.concat(F.lit("ghp_"), mixed(1, 36)),
                   F.concat(F.lit("sk_live_"), mixed(1, 24)), F.concat(F.lit("eyJ"), mixed(1, 30), F.lit(".eyJ"), mixed(31, 20), F.lit("."), mixed(51, 28)),
                   F.concat(F.initcap("w"), some(["!", "#", "@", "$"], "p"), mixed(3, 6), digits(9, 2))], "v")
    plain = some([digits(1, 16), digits(1, 11), F.substring(h, 1, 40), F.substring(h, 1, 32), h, F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
                  F.concat(F.lit("20"), digits(1, 2), F.lit("-0"), digits(5, 1), F.lit("-1"), digits(6, 1)), F.concat("w", F.lit("_"), digits(1, 4), F.lit(".pdf")),
                  F.concat("w", F.lit("."), digits(1, 2), F.lit("@"), F.reverse("w"), F.lit(".com")), F.concat(F.lit("lib/"), "w", F.lit("/v"), digits(1, 1), F.lit("."), digits(2, 2)),
                  F.concat_ws("-", digits(1, 3), digits(4, 3), digits(7, 4))], "v")
    filler = some([F.concat(F.lit("your-"), "w", F.lit("-key-"), digits(1, 2)), F.concat("w", "w", digits(1, 2)), F.concat(F.lit("example_"), "w", digits(1, 3)), F.concat(F.lit("xxxxxxxx"), digits(1, 2))], "f")
    kind = F.crc32(F.concat(h, F.lit("kind"))) % 10
    label = (kind < 5).cast("int")
    value = F.when(kind < 5, secret).when(kind < 9, plain).otherwise(filler)
    place = F.when((kind < 5) | (kind == 9), some(SECRET_PLACES, "s")).otherwise(some(PLAIN_PLACES, "s"))
    rows = hosts.select("h", "w", "host", label.alias("label"), value.alias("value"), place.alias("place"), some(SECRET_NAMES, "k").alias("k"),
                        some(["src1", "src2", "docs/notes.md", "config/app.yml", "tests/run.py", ".env"], "d").alias("source"))
    line = F.replace(F.replace(F.replace("place", F.lit("{k}"), F.col("k")), F.lit("{w}"), F.col("w")), F.lit("{v}"), F.col("value"))
    cut = F.length("host") / 2
    text = F.concat_ws(" ", F.substring("host", F.lit(1), cut.cast("int")), line, F.expr("substring(host, int(length(host) / 2) + 1)"))
    return rows.select(F.xxhash64("h").alias("doc_id"), "source", text.alias("text"), "value", "label")


def planted_findings(texts: DataFrame, known_words: DataFrame, chances: list[float], seed: str = "plant", max_rows: int = 2500) -> DataFrame:
    """Findings with FEATURES and label of planted(): those that hold the value."""
    docs = written(planted(texts, seed, max_rows), "planted")
    found = written(findings(docs).join(docs.select("doc_id", "value", "label"), "doc_id").where(F.contains(F.col("candidate"), F.col("value"))), "planted-findings")
    features = with_features(found.drop("value", "label"), known_words, chances)
    return features.join(found.select("doc_id", "n", "label"), ["doc_id", "n"])


def train(labelled: DataFrame, max_rows: int = 20000, trees: int = 16, depth: int = 6):
    """A forest from findings with FEATURES and label (0, 1); max_rows of each label at most, by a hash. None without both."""
    some = None
    for label in (0, 1):
        of = labelled.where(F.col("label") == label).orderBy(uniform(F.col("doc_id"), "secret"), "doc_id", "n", "candidate").limit(max_rows)
        some = of if some is None else some.unionAll(of)
    some = written(some.select(F.col("label").cast("double").alias("label"), *FEATURES), "secret-sample")
    if some.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(some)
    return RandomForestRegressor(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="0.4").fit(vectors)


def judged(featured: DataFrame, forest, least: float = 0.5) -> DataFrame:
    """Adds score (0 to 1) and is_secret; without a forest every finding stays with score 1."""
    score = vote(forest, [F.col(f) for f in FEATURES]) if forest else F.lit(1.0)
    return featured.withColumn("score", score).withColumn("is_secret", F.col("score") >= least)


def scan(docs: DataFrame, words_from: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, n, candidate_sha256, score, is_secret. The candidates themselves stay out of the result.

    labels: findings' labels (doc_id, n, label); without them planted ones are learnt. Defined cases: null and empty texts
    have no candidates; a null path counts as none; equal rows give equal findings; very long texts and candidates are
    judged whole; further columns of docs are not read; no rows give no rows.
    """
    known, found = written(dictionary(words_from), "dictionary"), written(findings(docs), "candidates")
    chances = transitions(known)
    featured = written(with_features(found, known, chances), "findings")
    labelled = featured.join(labels, ["doc_id", "n"]) if labels is not None else planted_findings(docs, known, chances)
    out = judged(featured, train(labelled))
    return out.select("doc_id", F.col("n").cast("long").alias("n"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    docs, talk = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "conversations"))
    return scan(docs, talk.select("text"))
