"""Secret scan with a random forest against false alarms, in DataFrame functions only.

Candidates are words of a text that look like credentials: a known form, a value
assigned to a telling name, or a long run that mixes letters and digits. A word may
hold several: known forms are cut out first, then assigned values, then runs, so
that none overlap, and each is a row. A block of a private key is one candidate over
its lines, and none of its words is another. A random forest then judges each by its
length, its changes of character class, how much of it dictionary words cover, the
document's path and the neighbouring words. The
forest is grown on the driver from labelled findings (a bounded table) and compiled
into column expressions; features of findings and of candidates are the same
expressions.

Edge cases: null and empty texts have no candidates; a null path counts as an empty
one; a secret that repeats is a row each time; without labelled findings of both
kinds every candidate has the share of label 1 as score; an empty table gives an
empty table.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FINDINGS = 20_000
WHITE = r"[\x20\x09-\x0D]+"

# Forms of credentials, a name and a pattern each.
KINDS = (
    ("private_key", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----.*?-----END [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----"),
    ("cloud_key_id", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_\-]{20}"),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9\-]{10,}"),
    ("service_key", r"(?:sk|pk|rk)[_\-](?:live_|test_|proj-)?[A-Za-z0-9_\-]{20,}"),
    ("web_token", r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*"),
    ("url_password", r"[a-z][a-z0-9+.\-]{1,9}://[^\s/:@]{1,64}:[^\s/@]{3,}@"),
)
ASSIGNED = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|auth|credential)s?[\"']?\s*[:=]+>?\s*[\"']?([^\s\"',;]{6,})"
SETTING = r"[&|?#{}()\[\]<>](?=[\w.\-]{1,64}[\"']?[:=])"  # before another name and value in one word
RUN = r"[A-Za-z0-9+/_=\-]{16,}"
STARTS = r"AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|[spr]k[_\-]|eyJ|://"
TELLING = r"(?i)passw|pwd|secret|token|api[_\-]?key|apikey|auth|credential|bearer|private|access[_\-]?key"
DOUBTFUL = r"(?i)example|dummy|placeholder|changeme|sha-?1|sha-?256|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|integrity|your|build|version|test"
ODD_PATH = r"(?i)(?:^|[/_.\-])(?:tests?|specs?|examples?|samples?|fixtures?|mocks?|docs?|vendor|node_modules|lock)(?:[/_.\-]|$)"
DICTIONARY = (
    "access", "account", "action", "address", "admin", "alpha", "array", "asset", "backup", "base", "beta", "block", "build", "button", "cache", "change", "class", "client", "cloud", "code",
    "column", "commit", "config", "content", "count", "create", "data", "default", "delete", "demo", "detail", "device", "document", "domain", "error", "event", "example", "field", "file", "filter",
    "form", "from", "function", "group", "handler", "header", "image", "index", "input", "item", "label", "list", "local", "manager", "member", "message", "method", "model", "module", "name",
    "number", "object", "option", "order", "page", "parent", "path", "placeholder", "private", "process", "project", "public", "query", "record", "release", "request", "response", "result", "sample", "script",
    "search", "secret", "server", "service", "session", "setting", "source", "state", "status", "string", "style", "system", "table", "target", "test", "text", "time", "title", "token", "type",
    "update", "user", "value", "version", "view", "with", "word", "your",
)
FEATURES = ("length", "transitions", "distinct", "digits", "uppers", "vowels", "hex", "dictionary", "known_form", "odd_path", "telling", "doubtful", "assigned")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """doc_id, path, at (number of the word, from 0), word, before, after (neighbours), value, kind: a row for each value in
    a word; ``word`` is what surrounds the value if there are several."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    # Most texts have nothing that could be part of a candidate; they stop here.
    some = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"[0-9]") | F.col("t").rlike(TELLING) | F.col("t").rlike(STARTS))
    words = some.select("doc_id", "path", F.split("t", WHITE).alias("ws"), key_blocks(F.col("t")).alias("blocks"))
    known = "|".join(p for _, p in KINDS[1:])
    long_run = lambda w: w.rlike(RUN) & w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    assigned = lambda w, p, q: F.when(w.rlike("[:=]"), w.rlike(ASSIGNED)).otherwise(F.lit(False)) | (p.rlike(r"[:=]>?[\"']?$") & F.concat_ws(" ", q, p).rlike(TELLING))

    def near(ws: Column, i: Column, k: int) -> Column:
        return F.coalesce(F.get(ws, i + k), F.lit(""))

    def found(ws: Column) -> Column:
        marked = F.transform(ws, lambda w, i: F.when((F.length(w) >= 6) & (long_run(w) | w.rlike(known) | assigned(w, near(ws, i, -1), near(ws, i, -2))), F.struct(i.alias("at"), w.alias("word"), F.concat_ws(" ", near(ws, i, -3), near(ws, i, -2), near(ws, i, -1)).alias("before"), near(ws, i, 1).alias("after"))))
        return F.filter(marked, lambda x: x.isNotNull())

    # The array is bound once; written straight it would be split again for every word.
    own = F.transform("blocks", lambda b: F.struct(b["at"].alias("at"), b["word"].alias("word"), F.concat_ws(" ", near(F.col("ws"), b["at"], -3), near(F.col("ws"), b["at"], -2), near(F.col("ws"), b["at"], -1)).alias("before"), near(F.col("ws"), b["end"], 1).alias("after")))
    single = F.get(F.transform(F.array("ws"), found), F.lit(0))
    apart = F.filter(single, lambda x: ~F.exists("blocks", lambda b: (x["at"] >= b["at"]) & (x["at"] <= b["end"])))
    all_ = F.when(F.size("blocks") > 0, F.concat(apart, own)).otherwise(single)
    hits = words.select("doc_id", "path", F.explode(all_).alias("c")).select("doc_id", "path", "c.at", "c.word", "c.before", "c.after")
    return with_value(hits)


def key_blocks(t: Column) -> Column:
    """Blocks of private keys in a text: ``word`` is the block, ``at`` and ``end`` the numbers of its first and last word."""
    pattern = KINDS[0][1]
    blocks, parts = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern)
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda x, y: x + F.length(y))
    word_of = lambda length: F.size(F.split(F.substring(t, F.lit(1), length), WHITE)) - 1

    def place(b: Column, k: Column) -> Column:
        begin = total(parts, k + 1) + total(blocks, k)
        return F.struct(word_of(begin).alias("at"), word_of(begin + F.length(b)).alias("end"), b.alias("word"))

    return F.when(F.contains(t, F.lit("PRIVATE KEY")), F.transform(blocks, place)).otherwise(F.array().cast("array<struct<at:int,end:int,word:string>>"))


def with_value(hits: DataFrame) -> DataFrame:
    """Adds kind and value to rows of (word, before), a row for each value in the word."""
    all_of = lambda pattern, group=0: F.regexp_extract_all("_cut", F.lit(pattern), F.lit(group))
    of_kind = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    gone = " ; "  # no value goes across it
    out = hits.withColumn("_cut", F.col("word"))
    for name, pattern in KINDS:
        out = out.withColumn(f"_{name}", all_of(pattern)).withColumn("_cut", F.regexp_replace("_cut", pattern, gone))
    out = out.withColumn("_cut", F.regexp_replace("_cut", SETTING, gone))
    out = out.withColumn("_assigned", all_of(ASSIGNED, 1)).withColumn("_cut", F.regexp_replace("_cut", ASSIGNED, gone))
    out = out.withColumn("_runs", F.filter(all_of(RUN), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")))
    some = F.concat(*(of_kind(name, F.col(f"_{name}")) for name, _ in KINDS), of_kind("assigned", F.col("_assigned")))
    named = F.col("before").rlike(r"[:=]>?[\"']?$")
    # The words before may name what the word begins with.
    head = F.when(named & F.col("before").rlike(TELLING), F.regexp_extract("_cut", r"^[\"'`(\[{<]*([^\s\"',;]{6,})", 1)).otherwise(F.lit(""))
    out = out.withColumn("_some", some).withColumn("_head", head)
    first = F.when(F.col("_head") != "", F.array(F.col("_head"))).otherwise(F.array().cast("array<string>"))
    many = F.concat(of_kind("assigned", first), "_some", of_kind("run", F.filter("_runs", lambda v: ~F.contains(F.col("_head"), v))))
    rest = F.regexp_replace("word", r"^[\"'`(\[{<]+|[\"'`)\]}>.,;:!?*#$%&]+$", "")
    single = F.array(F.struct(F.when(named, F.lit("assigned")).otherwise(F.lit("run")).alias("kind"), rest.alias("value")))
    out = out.withColumn("_all", F.when((F.size("_some") == 0) & (F.size("_runs") < 2), single).otherwise(many))
    out = out.withColumn("_n", F.size("_all")).withColumn("_v", F.explode("_all")).withColumn("kind", F.col("_v.kind")).withColumn("value", F.col("_v.value"))
    left = F.regexp_extract(F.expr("right(substring_index(word, value, 1), 48)"), r"[^,;&{}\s]*$", 0)
    word = F.when(F.col("_n") > 1, F.concat(left, "value")).otherwise(F.col("word")).alias("word")
    return out.select(*[word if c == "word" else F.col(c) for c in hits.columns], "kind", "value")


def features(hits: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to rows of (path, before, after, word, value, kind)."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    changes = F.regexp_count(v, F.lit(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
    around = F.concat_ws(" ", "before", "word", "after")
    return hits.withColumns(
        {
            "length": F.length(v).cast("double"),
            "transitions": changes / n,
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(32)),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "vowels": share("[aeiouAEIOU]"),
            "hex": F.when(v.rlike("^[0-9a-fA-F]+$"), 1.0).otherwise(0.0),
            "dictionary": 1 - F.length(F.regexp_replace(F.lower(v), "|".join(DICTIONARY), "")) / n,
            "known_form": F.when(F.col("kind").isin("assigned", "run"), 0.0).otherwise(1.0),
            "odd_path": F.when(F.col("path").rlike(ODD_PATH), 1.0).otherwise(0.0),
            "telling": F.when(F.concat_ws(" ", "before", "word").rlike(TELLING), 1.0).otherwise(0.0),
            "doubtful": F.when(around.rlike(DOUBTFUL), 1.0).otherwise(0.0),
            "assigned": F.when(F.col("before").rlike(r"[:=]>?[\"']?$") | F.col("word").rlike(r"[A-Za-z][\"']?[:=]"), 1.0).otherwise(0.0),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 2400) -> DataFrame:
    """Findings (path, before, word, after, label) made by rule from hashes of a counter: secrets, and what is taken for them."""
    i, h = F.col("id"), F.sha1(F.col("id").cast("string"))
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.xxhash64("id"), F.lit(len(x))) + 1).cast("int"))
    other = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(len(x))) + 1).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2(i.cast("string").cast("binary"), 256))), "=+$", "")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name = pick("token", "api_key", "secret", "password", "auth_token", "access_key")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    cases = [
        (F.concat_ws(" ", other("the", "set", "with", "und", "la"), name, F.lit("=")), quoted(h), 1),
        (F.concat_ws(" ", name, F.lit("=")), quoted(F.upper(h)), 1),
        (F.concat_ws(" ", F.lit("export"), name, F.lit(":")), quoted(b64), 1),
        (pick("use", "for", "with"), F.concat(name, F.lit("="), F.substring(b64, 1, 24)), 1),
        (pick("key", "id", "is"), F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(h, "0189", "QRST"), 1, 16))), 1),
        (pick("bearer", "header", "send"), F.concat(F.lit("ghp_"), F.substring(F.concat(b64, h), 1, 36)), 1),
        (F.concat(pick("commit", "sha1", "checksum", "revision"), other(" ", " = ", " :", " is")), h, 0),
        (F.concat_ws(" ", pick("the", "in", "see", "of"), other("file", "page", "version", "build")), h, 0),
        (F.concat_ws(" ", pick("uuid", "guid", "record", "the"), F.lit("=")), uuid, 0),
        (F.concat_ws(" ", name, F.lit("=")), pick("your_api_key_placeholder1", "example-token-value-123", "changeme_default_password1", "test_secret_value_0001"), 0),
        (pick("call", "the", "use"), F.concat(other("createSessionManager", "updateRecordHandler", "defaultServiceConfig"), F.substring(h, 1, 1), F.lit("2")), 0),
        (pick("at", "in", "from"), F.concat(F.lit("src/main/"), other("module", "service", "handler"), F.lit("/file_list_"), F.pmod(i, F.lit(97)).cast("string")), 0),
        (pick("key:", "below", "|"), F.concat(F.lit("-----BEGIN "), other("RSA ", "EC ", "OPENSSH ", ""), F.lit("PRIVATE KEY-----\n"), b64, F.lit("\n"), b64, F.lit("\n-----END PRIVATE KEY-----")), 1),
        (pick("url", "connect", "at"), F.concat(other("postgres", "amqp", "https"), F.lit("://admin:"), F.substring(b64, 3, 14), F.lit("@db.internal/main")), 1),
        (F.concat_ws(" ", pick("client", "deploy", "bot"), name, F.lit("is")), F.substring(b64, 1, 32), 1),
        (pick("stripe", "pay", "key"), F.concat(other("sk_live_", "rk_live_", "sk_test_"), F.substring(F.concat(h, h), 5, 24)), 1),
        (pick("src", "href", "image", "from"), F.concat(F.lit("https://cdn.site.org/"), other("assets", "img", "media"), F.lit("/"), F.substring(h, 1, 16), F.lit(".png")), 0),
        (F.concat_ws(" ", pick("integrity", "resolved", "digest"), F.lit(":")), F.concat(other("sha512-", "sha256-", "sha1-"), b64), 0),
        (pick("invoice", "order", "ticket", "ref"), F.concat(other("INV", "ORD", "TCK"), F.lit("-2024-"), F.lpad(F.pmod(i, F.lit(99991)).cast("string"), 8, "0")), 0),
        (pick("etag", "build", "trace", "session"), F.concat(other("b", "v", "t"), F.substring(h, 1, 20)), 0),
    ]
    before, word, label = F.lit(None), F.lit(None), F.lit(None)
    for k, (b, w, y) in enumerate(cases):
        here = F.pmod(i, F.lit(len(cases))) == k
        before, word, label = F.when(here, b).otherwise(before), F.when(here, w).otherwise(word), F.when(here, F.lit(y)).otherwise(label)
    path = F.when(F.pmod(F.xxhash64("id", F.lit(2)), F.when(label == 1, F.lit(20)).otherwise(F.lit(4))) == 0, F.lit("tests/fixtures/data")).otherwise(F.lit("src"))
    return spark.range(n).select("id", before.alias("before"), word.alias("word"), F.lit("").alias("after"), label.alias("label"), path.alias("path")).drop("id")


Tree = float | tuple  # a leaf's share of label 1, or (feature, threshold, at most, above)


def grow(x: list[list[float]], y: list[int], rows: list[int], depth: int, rng: random.Random, tries: int) -> Tree:
    """A tree on the rows by Gini impurity, over a random few of the features at each node."""
    ones = sum(y[r] for r in rows)
    if depth == 0 or ones in (0, len(rows)) or len(rows) < 8:
        return ones / max(1, len(rows))
    best = None
    for j in rng.sample(range(len(x[0])), tries):
        order = sorted(rows, key=lambda r: x[r][j])  # noqa: B023
        left = 0
        for k in range(1, len(order)):
            left += y[order[k - 1]]
            if x[order[k]][j] == x[order[k - 1]][j]:
                continue
            right, m = ones - left, len(order) - k
            score = left * (k - left) / k + right * (m - right) / m
            if best is None or score < best[0]:
                best = (score, j, (x[order[k]][j] + x[order[k - 1]][j]) / 2)
    if best is None:
        return ones / len(rows)
    _, j, t = best
    return (j, t, grow(x, y, [r for r in rows if x[r][j] <= t], depth - 1, rng, tries), grow(x, y, [r for r in rows if x[r][j] > t], depth - 1, rng, tries))


def forest(findings: DataFrame, trees: int = 24, depth: int = 6, seed: int = 5, bound: int = MAX_FINDINGS) -> list[Tree]:
    """Trees on bootstrap samples of the labelled findings, ``bound`` of them at most in the order of a hash."""
    rows = features(with_value(findings.where(F.col("label").isNotNull()))).orderBy(F.xxhash64("before", "word", "after", "path"), "word", "before").limit(bound).select("label", *FEATURES).collect()
    x, y = [[float(r[f]) for f in FEATURES] for r in rows], [int(r.label) for r in rows]
    if not rows or sum(y) in (0, len(y)):
        return [(sum(y) + 1) / (len(y) + 2)]
    rng = random.Random(seed)
    return [grow(x, y, [rng.randrange(len(y)) for _ in y], depth, rng, 4) for _ in range(trees)]


def compiled(trees: list[Tree]) -> Column:
    """The forest's mean vote as one expression over ``FEATURES``."""

    def column(t: Tree) -> Column:
        return F.when(F.col(FEATURES[t[0]]) <= t[1], column(t[2])).otherwise(column(t[3])) if isinstance(t, tuple) else F.lit(float(t))

    total = column(trees[0])
    for t in trees[1:]:
        total = total + column(t)
    return total / len(trees)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, at, kind, value, before, after, score, is_secret: a row for each candidate; false alarms have is_secret false."""
    model = compiled(forest(labelled_findings(docs.sparkSession) if findings is None else findings))
    judged = features(candidates(docs, id_col, text_col, path_col)).withColumn("score", model)
    return judged.select("doc_id", "at", "kind", "value", "before", "after", "score", (F.col("score") >= threshold).alias("is_secret"))
