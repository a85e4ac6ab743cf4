"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is an access key's fixed form, a signed token of parts joined by dots, a private key's block from BEGIN to END
(without END: the head and the lines of key after it), any value that is assigned to a name with a secret word in it, or a
run of at least 12 key-like characters that holds a digit, however long the run and wherever the digit. A quoted value goes to its closing quote, another to the next white space or quote. Features are length, character transitions, dictionary coverage, the path of its document and the words beside it. The forest is trained on
labelled findings (a bounded table; without one, labelled_findings() makes one from a seed) and evaluated inside Spark:
its nodes are arrays, and a tree is walked by higher-order functions.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a candidate may be, words that mark an assignment of a secret or a harmless identifier, and a dictionary.
SECRET_WORDS = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private)"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SIGNED = r"(?<![A-Za-z0-9_+/\-])eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]+){1,4}+"
KEY_END = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
KEY_BLOCK = rf"-----BEGIN {KEY_END}(?:(?:[^-]++|-(?!----))*+-----END {KEY_END}|(?:(?:\s|\\[rn])++[A-Za-z0-9+/]{{16,}}+={{0,2}})*+)"
#: After a name with a secret word and a mark of assignment. The first part is cheap and fails at most places.
ASSIGNED = rf"(?<=[=:>]\s{{0,3}}[\"'`]?|(?i:bearer|basic)\s)(?<=(?:{SECRET_WORDS})[A-Za-z0-9_.\-]{{0,30}}[\"'`\])]{{0,2}}\s{{0,3}}[=:]{{1,2}}>?\s{{0,3}}[\"'`]?(?:(?:bearer|basic)\s)?)(?!(?i:bearer|basic)\s)"
VALUE = r"(?:(?<=\")[^\"\n]+(?=\")|(?<=')[^'\n]+(?=')|(?<=`)[^`\n]+(?=`)|[^\s\"'`=:>][^\s\"'`]*)"
RUN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9])[A-Za-z0-9_+/\-]{12,}={0,2}"
CANDIDATE = f"{ACCESS_KEY}|{SIGNED}|{KEY_BLOCK}|{ASSIGNED}{VALUE}|{RUN}"
HARMLESS_WORDS = r"(?i)(?:sha1|sha256|md5|checksum|digest|commit|uuid|guid|revision|etag|integrity|hash|order|invoice|card|phone|isbn|version|build|example|http)"
KNOWN_HEADS = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|eyJ|npm_|pypi-|-----BEGIN)"
WORDS = """
about access account action address admin after alpha also and any archive article auth author backup base book build
cache call can center change changeme channel check client cloud code com commit company config connect content control
copy create customer data date day default demo device digest docs document domain dummy edit email error event example
export field file find first folder for form format from get group guide hash head help hidden home host house html http
image index info input invoice item job just key know label language level library line link linux list local login look
mail make map master media member memory menu message module money month more most name network news next node note
object only open order org out package page paper part path people phone place placeholder plan point post private
product public query release report sample search server service set site size source space start string system test
text that the their this time title type update user value version video view web with word work world write your
"""
DICTIONARY = "(?:" + "|".join(sorted(WORDS.split(), key=lambda w: (-len(w), w))) + ")"
BIGRAMS = r"(?:th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ou|ea|ng|le|se|ha)"
TEST_PATH = r"(?i)(?:tests?|specs?|fixtures?|examples?|samples?|mocks?|docs?)(?:[/._-]|$)"
#: Values that name, call or hide something rather than being it.
NO_VALUE = r"(?i)^(?:true|false|null|none|nil|yes|no|on|off|undefined|required|optional|enabled|disabled|string|str|int|bool)?[,;.)\]}]*$|^[$<{\[(%*&]|^[*x.]+$|[(\[{]|^[A-Za-z]{1,12}\.[A-Za-z_.]+|^(?:your|my)[_-]"
#: Characters before and after a candidate in which its neighbours are looked for.
BEFORE, AFTER = 32, 16
TREES, DEPTH, FINDINGS = 40, 7, 20_000
THRESHOLD = 0.5
MASK = "[secret]"


def features(c: Column, before: Column, after: Column, path: Column) -> list[Column]:
    n = F.length(c).cast("double")
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern)).cast("double")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    left = lambda x, pattern: (F.length(x) - F.length(F.regexp_replace(x, pattern, ""))).cast("double")
    low = F.lower(c)
    return [
        n,
        count(c, "[0-9](?=[A-Za-z])") / n,
        count(c, "[A-Za-z](?=[0-9])") / n,
        count(c, "[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        count(low, BIGRAMS) / n,
        count(c, "[0-9]") / n,
        count(c, "[A-Z]") / n,
        count(c, "[_+/-]") / n,
        F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        flag(c.rlike("^[0-9a-fA-F]+$")),
        flag(c.rlike("^[0-9_+/-]+$")),
        flag(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        flag(c.rlike(KNOWN_HEADS)),
        left(low, DICTIONARY) / n,
        flag(path.rlike(TEST_PATH)),
        flag(before.rlike(SECRET_WORDS + "[^\\n]{0,12}$")),
        flag(before.rlike("[=:]\\s?[\"'`]?$")),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        flag(before.rlike(HARMLESS_WORDS + "[^\\n]{0,12}$")),
        flag(before.rlike("[./@]$") | after.rlike("^[.@]\\w")),
        count(c, "[^A-Za-z0-9_+/-]") / n,
        flag(c.rlike(NO_VALUE)),
    ]


def labelled_findings(n: int = 4000, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label): made up, half of them secrets. Another seed gives findings to test on."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve con que ment ado los ein ich sch eux".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda: " ".join(word() for _ in range(6))[-24:] + " "
    paths = ["src0", "src17", "web/crawl", "app/settings.py", "deploy/env", "README", "lib/main.go"]
    tests = ["tests/test_auth.py", "docs/example.md", "spec/fixture.json"]
    out = []
    for i in range(n):
        path = r.choice(paths) if r.random() < 0.85 else r.choice(tests)
        joint = r.choice([" = ", "=", ": ", ' = "', "='", ':"', ": '"])
        tail = joint[-1] if joint[-1] in "\"'" else " "
        if i % 2:
            kind = r.random()
            if kind < 0.35:
                c = r.choice([lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: "sk_live_" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35), lambda: "glpat-" + pick(alnum, 20), lambda: "eyJ" + pick(alnum + "_-", 33) + "." + pick(alnum + "_-", r.randint(20, 90)) + "." + pick(alnum + "_-", 43), lambda: "-----BEGIN " + r.choice(["", "RSA ", "EC "]) + "PRIVATE KEY-----"])()
                b, a = (words(), " " + word()) if r.random() < 0.6 else (words() + r.choice(["key", "token", "secret"]) + joint, tail + word())
            else:
                name = r.choice(["token", "password", "passwd", "secret", "api_key", "apikey", "auth_token", "access_key", "client_secret", "pwd", "Token", "PASSWORD"])
                c = pick(r.choice([hexa, hexa, alnum, b64, alnum + "_-"]), r.choice([12, 16, 18, 20, 24, 32, 40, 40, 64]))
                if not any(x.isdigit() for x in c):
                    c = c[:-1] + "7"
                b, a = words() + name + joint, tail + word()
        else:
            kind = r.randrange(9)
            b, a = words(), " " + word()
            if kind == 0:
                c, b = pick(hexa, r.choice([32, 40, 64])), b + r.choice(["commit ", "sha256:", "md5 ", "checksum = ", "digest: ", "revision ", "etag=\"", ""])
            elif kind == 1:
                c = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
                b += r.choice(["id=", "uuid: ", "guid ", ""])
            elif kind == 2:
                c = pick(string.digits, r.choice([12, 13, 14, 15, 16, 16, 16, 19]))
                b += r.choice(["", "", "", "card ", "order ", "invoice: ", "phone ", "id="])
            elif kind == 3:
                c = "".join(word() for _ in range(6))[: r.randint(12, 30)] + pick(string.digits, r.randint(1, 4))
                if r.random() < 0.3:
                    b += r.choice(["name = \"", "file: ", "title="])
            elif kind == 4:
                c = r.choice(["example", "test", "dummy", "changeme", "sample", "placeholder"]) + r.choice(["-", "_", ""]) + r.choice(["token", "password", "key", "user", "value"]) + pick("0123456789", r.randint(1, 4)) + r.choice(["", "example"])
                b += r.choice(["token = \"", "password=", ""])
            elif kind == 5:
                c = "/".join(word() for _ in range(4)) + f"/{r.randint(1, 2024)}/{word()}{r.randint(0, 99)}"
                b += r.choice(["http:/", "https://www.", "", "path: "])
            elif kind == 6:
                c = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}" if r.random() < 0.5 else "+" + pick(string.digits, 2) + "-" + pick(string.digits, 4) + "-" + pick(string.digits, 5)
            elif kind == 7:
                c = word() + "_" + word() + "_" + word() + "_v" + pick(string.digits, 2) + "_" + word()
                if r.random() < 0.3:
                    b += "version="
            else:
                c, a = word() + pick(string.digits, 2) + "-" + word() + word() + word() + pick(string.digits, 2), "@mail3.example.com"
            if len(c) < 12:
                c += "-" + word() + word() + word() + pick(string.digits, 3)
        out.append((c, b[-BEFORE:], a[:AFTER], path, i % 2))
    # Values of any form after a secret word: chosen by people or made of marks, and what stands there without being one.
    for i in range(n // 2):
        joint = r.choice([" = ", "=", ": ", ' = "', "='", ':"', ': "', ' = "'])
        quoted = joint[-1] in "\"'"
        name = r.choice(["token", "password", "passwd", "secret", "api_key", "apikey", "pwd", "Password", "DB_PASSWORD", "client_secret"])
        if i % 2:
            c = r.choice([
                lambda: "".join(word() for _ in range(r.randint(3, 7))),
                lambda: "".join(r.choice([word(), word().title(), r.choice("@&!#%.$-_"), pick(string.digits, r.randint(1, 4))]) for _ in range(r.randint(3, 6))) + r.choice("!&@#$") + pick(string.digits, 2),
                lambda: pick(alnum + "!@#&%-_.", r.randint(6, 16)),
                lambda: pick(string.ascii_letters, r.choice([12, 16, 20, 24, 28, 32, 40])),
                lambda: "-----BEGIN " + r.choice(["", "RSA ", "EC "]) + "PRIVATE KEY-----\n" + "\n".join(pick(b64, 64) for _ in range(r.randint(1, 20))) + "\n-----END PRIVATE KEY-----",
            ])()
        else:
            c = r.choice([
                lambda: r.choice(["true", "false", "null", "None", "yes", "no", "required", "optional", "enabled", "string", "true,", "null,"]),
                lambda: r.choice(["${", "<", "{{", "$", "%"]) + r.choice(["TOKEN", "password", "SECRET_KEY", "your-token"]) + r.choice(["}", ">", "}}", ""]),
                lambda: r.choice(["get", "load", "read", "input"]) + "_" + word() + "(" + r.choice(["", ")", "name)"]),
                lambda: r.choice(["os.environ[", "config.", "settings.", "self.", "process.env."]) + word(),
                lambda: r.choice(["changeme", "example", "placeholder", "dummy", "your-password", "test", "sample", "****", "xxxxxx"]) + r.choice(["", "", "-value", "_here"]),
                lambda: word() + r.choice(["", ",", "."]),
            ])()
            if not quoted and r.random() < 0.4:
                name = r.choice(["author", "private", "authors", "tokens", "secret"])
        out.append((c, (words() + name + joint)[-BEFORE:], (joint[-1] if quoted else " ") + word()[: AFTER - 1], r.choice(paths), i % 2))
    return out


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right and value (share of secrets) of each node."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 29):
        self.feature, self.limit, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        rng = np.random.default_rng(seed)
        for _ in range(trees):
            own = rng.integers(0, len(y), len(y))
            self.roots.append(self.grow(x[own], y[own], depth, rng))

    def grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng) -> int:
        at = len(self.value)
        for a, v in ((self.feature, -1), (self.limit, 0.0), (self.left, at), (self.right, at), (self.value, float(y.mean()))):
            a.append(v)
        if not depth or len(y) < 8 or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        for f in rng.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1])) + 1)]:
            o = np.argsort(x[:, f], kind="stable")
            v, ones = x[o, f], np.cumsum(y[o])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n, k = len(y), cut + 1.0
            p, q = ones[cut] / k, (ones[-1] - ones[cut]) / (n - k)
            gain = y.mean() * (1 - y.mean()) - (k * p * (1 - p) + (n - k) * q * (1 - q)) / n
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[1] < 0:
            return at
        self.feature[at], self.limit[at] = best[1], best[2]
        low = x[:, best[1]] <= best[2]
        self.left[at] = self.grow(x[low], y[low], depth - 1, rng)
        self.right[at] = self.grow(x[~low], y[~low], depth - 1, rng)
        return at

    def score(self, x: Column) -> Column:
        """The mean over the trees for features x, an array."""
        literal = lambda values, kind: F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), f"array<{kind}>")
        feature, limit, left, right, value = literal(self.feature, "int"), literal(self.limit, "double"), literal(self.left, "int"), literal(self.right, "int"), literal(self.value, "double")
        step = lambda n: F.when(F.get(feature, n) < 0, n).when(F.get(x, F.get(feature, n)) <= F.get(limit, n), F.get(left, n)).otherwise(F.get(right, n))
        leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), root, lambda n, _: step(n))
        return F.aggregate(F.transform(literal(self.roots, "int"), lambda r: F.get(value, leaf(r))), F.lit(0.0), lambda a, b: a + b) / len(self.roots)


def train(spark: SparkSession, findings: DataFrame | None = None) -> Forest:
    """findings: candidate, before, after, path, label (0 or 1); at most FINDINGS of them, those that hash least."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "candidate string, before string, after string, path string, label int")
    x = F.array(*features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path")))
    rows = findings.na.fill("").where("label in (0, 1) and candidate <> ''").select(x.alias("x"), "label", F.xxhash64("candidate", "before", "after", "path").alias("h")).orderBy("h", "label").limit(FINDINGS).collect()
    if len({r["label"] for r in rows}) < 2:
        raise ValueError("findings of both kinds are needed")
    return Forest(np.array([r["x"] for r in rows], float), np.array([r["label"] for r in rows], float))


def scanned(docs: DataFrame, forest: Forest, text: str = "text", path: str = "source") -> DataFrame:
    """A row for each of docs: doc (all its columns), hits (each candidate c, the text `between` it and the one before, its score), tail.

    Null and empty texts have no candidates, a null path is none. Texts are scanned whole. No column of docs can clash.
    Each step maps one array, as an array that is looked up by place within a map may be made again for every element.
    """
    body, where = F.coalesce(F.col(f"doc.`{text}`"), F.lit("")), F.coalesce(F.col(f"doc.`{path}`"), F.lit(""))
    got = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    got = got.select("doc", F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)).alias("c"))
    got = got.select("doc", "c", F.when(F.size("c") > 0, F.split(body, CANDIDATE, -1)).otherwise(F.array(body)).alias("between"))
    got = got.select("doc", F.slice(F.arrays_zip("c", "between", F.slice("between", 2, F.size("c") + 1).alias("next")), 1, F.size("c")).alias("hits"), F.element_at("between", -1).alias("tail"))
    seen = lambda h: F.array(*features(h["c"], F.substring(h["between"], -BEFORE, BEFORE), F.substring(h["next"], 1, AFTER), where))
    got = got.select("doc", F.transform("hits", lambda h: F.struct(h["c"].alias("c"), h["between"].alias("between"), seen(h).alias("x"))).alias("hits"), "tail")
    return got.select("doc", F.transform("hits", lambda h: F.struct(h["c"].alias("c"), h["between"].alias("between"), forest.score(h["x"]).alias("score"))).alias("hits"), "tail")


def findings(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each secret: doc_id, start and length (characters), digest (SHA-256, never the secret itself), score.

    Starts are running sums over a text's candidates, one row each, so that a text of any number of them costs in
    proportion. Null and empty texts give no rows; rows that repeat give theirs again.
    """
    lean = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(path).alias("source")).where(F.col("text").rlike(CANDIDATE))
    got = scanned(lean, forest, "text", "source").select("doc.doc_id", F.monotonically_increasing_id().alias("row"), "hits").where(F.exists("hits", lambda h: h["score"] >= threshold))
    each = F.transform("hits", lambda h: F.struct((F.length(h["between"]) + F.length(h["c"])).alias("past"), F.length(h["c"]).alias("length"), F.when(h["score"] >= threshold, F.sha2(h["c"], 256)).alias("digest"), h["score"].alias("score")))
    rows = got.select("doc_id", "row", F.posexplode(each).alias("at", "s")).select("doc_id", "row", "at", "s.*")
    end = F.sum("past").over(Window.partitionBy("row").orderBy("at"))
    return rows.withColumn("start", (end - F.col("length")).cast("int")).where("digest is not null").select("doc_id", "start", "length", "digest", F.round("score", 6).alias("score"))


def redacted(docs: DataFrame, forest: Forest, text: str = "text", path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret replaced by MASK; other texts, null ones included, and all other columns stay as they are."""
    got = scanned(docs, forest, text, path)
    parts = F.transform("hits", lambda h: F.concat(h["between"], F.when(h["score"] >= threshold, MASK).otherwise(h["c"])))
    new = F.when(F.exists("hits", lambda h: h["score"] >= threshold), F.concat(F.array_join(parts, ""), "tail")).otherwise(F.col(f"doc.`{text}`"))
    return got.select(*(new.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all documents; see findings(). Very long texts are scanned whole; empty tables and texts give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return findings(docs, train(spark))
