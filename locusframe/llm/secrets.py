"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are long tokens of letters with digits, values given to names like password or token, and
blocks of private keys. A forest of decision trees judges each by its length, characters and their
transitions, dictionary coverage, path and the four words on either side.

The forest learns from labelled findings: rows (text, start, end, path, secret), at most SAMPLE of
them, those with the smallest hash. The corpus has no labels for secrets, so findings() makes such
rows: by a seed, from the public forms of keys and from what scanners mistake for keys (digests,
commit ids, identifiers, numbers, file names, placeholders, long words).

Cases: null and empty texts have no candidates; a null path is empty; candidates that overlap count
once, the first; texts of any length are read whole; repeated rows each get a row; without labelled
findings of both kinds the forest gives the share of secrets among them (none: a half); equal findings
count as often as they are there; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import annotate, table, texts

SAMPLE = 4_000
TREES, DEPTH, LEAF = 25, 8, 3
THRESHOLD = 0.5
#: Neighbouring words on either side, and characters in which they are looked for.
NEAR, REACH = 4, 4_096
MARK = "[SECRET]"

#: Names before a secret, words before what is none, words of paths that hold examples.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "auth", "bearer", "credential", "credentials", "access", "private", "authorization", "pass")
PLAIN_NAMES = ("sha", "sha1", "sha256", "md5", "hash", "digest", "checksum", "commit", "revision", "etag", "uuid", "guid", "id", "order", "invoice", "version", "build", "isbn", "serial", "tracking", "file", "path", "blob", "parent", "tree", "fingerprint", "integrity")
EXAMPLE_PATHS = ("test", "tests", "example", "examples", "sample", "docs", "doc", "mock", "fixture", "fixtures", "lock", "vendor")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "npm_", "pypi-", "SG.", "hf_")
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "dummy", "sample", "redacted", "test", "todo", "insert")
#: Common words for dictionary coverage and the transitions of plain text.
DICTIONARY = (
    "the and for are but not you all any can her was one our out day get has him his how man new now old see two way who did its let put say she too use "
    "that with have this will your from they know want been good much some time very when come here just like long make many more only over such take than them well were "
    "about after again below could every first found great house large learn never other place plant point right small sound spell still study their there these thing think three water where which world would write "
    "access account action active address admin agent alert allow apple archive array asset author backup banner basic batch block board branch build button cache call camera change chart check client cloud code color column command common config connect content control copy core count course create current custom data date debug default delete design detail device dialog direct display document domain download driver edit editor email enable engine entry error event example export extra factory feature field file filter folder format frame function global graph green group handler header height hidden history home host image import index info input insert install item java job json kernel label language layout level library license light limit line link linux list local login logo loop machine mail main manager map master match media member memory menu message method mobile mode model module monitor mount name network node note number object online open option order output package page panel parent parse parser path pattern payment phone picture platform player plugin policy pool port post price print process product profile program project property proxy public query queue quick random range rate read record region release remote render report request reset resource response result return role root route rule run sample schema scope screen script search section select sender server service session setting share shell shop simple site size slide socket sort source space stack start state static status step storage store stream string style submit support switch sync system table target task team template term test text theme thread title tool topic total track transfer tree trigger type unit update upload user utils value vector version video view virtual visit voice volume wait watch web week widget width window word work worker yellow zone"
).split()

TOKEN = r"[A-Za-z0-9_+/=\-]"
#: What a name like password may have before it (DB_, --app-, my in myPassword) and after it (_prod, 2).
BEFORE = r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{0,40}[_\-./+]){0,12}(?-i:[A-Za-z0-9]{1,40}?(?<=[a-z0-9])(?=[A-Z]))?"
AFTER = r"(?-i:[0-9]{0,4}(?:[_\-][A-Za-z0-9]{1,40}|[A-Z][a-z0-9]{1,40}){0,4})"
#: What lies between the lines of a key, also where line breaks are written out; a key without an end reaches as far as its lines do.
BREAK = r"(?:\s|\\[nrt]){1,8}"
LINES = rf"(?:{BREAK}(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*)*(?:{BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:{BREAK}[A-Za-z0-9+/]+(?:={{1,2}}|(?=\s*\Z)))?"
CANDIDATE = re.compile(
    rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN ).)*?-----END [A-Z ]*PRIVATE KEY-----|{LINES})"
    rf"|(?i:{BEFORE}(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret){AFTER})[\"']?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\"']?(?P<value>[^\s\"'<>,;]{{6,}})"
    rf"|(?<!{TOKEN})(?={TOKEN[:-1].replace('0-9', '')}]*[0-9])(?P<token>{TOKEN}{{16,}})",
    re.S,
)
WORD = re.compile(r"[A-Za-z][A-Za-z0-9]*")


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span(m.lastgroup or 0)
        while b > a and text[b - 1] in "!.:)]}%*#$&":  # marks after a value are no part of it
            b -= 1
        if b - a >= 6:
            out.append((a, b))
    return out


def words_before(text: str, at: int) -> list[str]:
    """The NEAR words before a place; the part of the text that is looked at grows until it has them."""
    size = 64
    while True:
        found = WORD.findall(text, max(0, at - size), at)
        if len(found) > NEAR or size >= min(at, REACH):
            return found[-NEAR:]
        size *= 4


def transitions() -> np.ndarray:
    """Log probabilities of the next letter in plain words."""
    counts = np.ones((27, 27))
    for w in DICTIONARY:
        at = [0, *(ord(c) - 96 for c in w), 0]
        for a, b in zip(at, at[1:]):
            counts[a, b] += 1
    return np.log(counts / counts.sum(1, keepdims=True))


class Features:
    NAMES = ("length", "entropy", "distinct", "digits", "upper", "signs", "hex", "switches", "transitions", "coverage", "prefix", "placeholder", "run", "uuid", "secret_name", "plain_name", "plain_after", "assigned", "quoted", "example_path", "slashes", "pem", "lower_words")

    def __init__(self) -> None:
        self.log = transitions()
        self.words = frozenset(w for w in DICTIONARY if len(w) > 3)

    def coverage(self, low: str) -> float:
        """Share of characters in dictionary words, taken greedily from the left."""
        at, covered, n = 0, 0, len(low)
        while at < n:
            size = next((k for k in range(min(10, n - at), 3, -1) if low[at : at + k] in self.words), 0)
            covered += size
            at += size or 1
        return covered / max(1, n)

    def of(self, text: str, a: int, b: int, path: str) -> list[float]:
        value = text[a:b]
        n, low = len(value), value.lower()
        counts = Counter(value)
        classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
        letters = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in low]
        parts = [w.lower() for w in words_before(text, a)]
        after = [m[0].lower() for m in islice(WORD.finditer(text, b, b + REACH), NEAR)]
        gap = text[max(0, a - 4) : a]
        paths = WORD.findall(path.lower())
        return [
            float(n),
            -sum(c / n * math.log2(c / n) for c in counts.values()),
            len(counts) / n,
            classes.count("d") / n,
            classes.count("u") / n,
            classes.count("s") / n,
            float(all(c in "0123456789abcdefABCDEF" for c in value)),
            sum(x != y for x, y in zip(classes, classes[1:])) / n,
            float(np.mean(self.log[letters[:-1], letters[1:]])) if n > 1 else 0.0,
            self.coverage(low),
            float(value.startswith(PREFIXES)),
            float(any(p in low for p in PLACEHOLDERS)),
            float(max(len(m[0]) for m in re.finditer(r"(.)\1*", value, re.S))),
            float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
            float(any(p in SECRET_NAMES for p in parts)),
            float(any(p in PLAIN_NAMES for p in parts)),
            float(any(p in PLAIN_NAMES for p in after)),
            float(bool(re.search(r"[:=]", gap))),
            float(bool(re.search(r"[\"']\Z", gap))),
            float(any(p in EXAMPLE_PATHS for p in paths)),
            value.count("/") / n,
            float(value.startswith("-----BEGIN")),
            float(classes.count("l") == n),
        ]


def findings(n: int = SAMPLE, seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings (text, start, end, path, secret), made by a seed."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    alnum, lower = string.ascii_letters + string.digits, string.digits + "abcdef"

    def words(k: int) -> str:
        return " ".join(rng.choice(DICTIONARY) for _ in range(k))

    def odd(k: int) -> str:  # words of no dictionary
        return " ".join("".join(rng.choice(("th", "er", "on", "an", "re", "ou", "é", "ung", "ción", "lich")) for _ in range(rng.randint(1, 5))) for _ in range(k))

    def secret() -> tuple[str, str]:
        name = rng.choice(("token", "api_key", "secret", "password", "auth_token", "access_key", "private_key", "client_secret", "TOKEN", "API_KEY", "SECRET_KEY", "credentials"))
        kind = rng.randrange(8)
        value = (
            pick(lower, rng.choice((32, 40, 40, 40, 64))) if kind < 3
            else pick(lower.upper(), 40) if kind == 3
            else pick(alnum, rng.randint(20, 48)) if kind == 4
            else rng.choice(("ghp_", "sk_live_", "glpat-", "npm_", "hf_", "sk-")) + pick(alnum, rng.randint(20, 40)) if kind == 5
            else "AKIA" + pick(string.ascii_uppercase + "234567", 16) if kind == 6
            else pick(alnum + "+/", rng.randint(24, 64)) + rng.choice(("", "=", "=="))
        )
        if rng.random() < 0.08:
            value = pick(alnum + "!@$%^&*", rng.randint(9, 16))
            name = rng.choice(("password", "passwd", "pwd"))
        if rng.random() < 0.06:
            kind = rng.choice(("RSA ", "EC ", "", "OPENSSH "))
            return "", f"-----BEGIN {kind}PRIVATE KEY-----\n{pick(alnum + '+/', rng.randint(8, 200))}\n-----END {kind}PRIVATE KEY-----"
        return f"{name}{rng.choice((' = ', '=', ': ', ' := ', ' => '))}{rng.choice(('\"', '\"', "'", ''))}", value

    def plain() -> tuple[str, str]:
        kind = rng.randrange(11)
        digest = f"{rng.choice(('commit', 'sha1', 'sha256', 'md5', 'checksum', 'etag', 'revision', 'blob', 'tree', 'hash'))}{rng.choice((' ', ': ', '=', ' = \"', ':\"'))}"
        ident = f"{rng.choice(('id', 'uuid', 'order', 'guid', 'tracking', 'serial', 'build'))}{rng.choice((' ', ': ', '=', ' = \"'))}"
        return (
            (digest, pick(lower, rng.choice((32, 40, 64)))) if kind < 3
            else (ident, "-".join(pick(lower, k) for k in (8, 4, 4, 4, 12))) if kind == 3
            else (rng.choice(("", "", ident)), pick(string.digits, rng.randint(16, 22))) if kind == 4
            else (rng.choice(("", "", "see ", "in ")), "-".join(rng.choice(DICTIONARY) for _ in range(4)) + f"-{rng.randint(1, 2030)}") if kind == 5
            else (rng.choice(("", "import ", "path: ")), "/".join(rng.choice(DICTIONARY) for _ in range(4)) + f"/v{rng.randint(1, 9)}") if kind == 6
            else (rng.choice(("password: ", "api_key = \"", "token=", "secret: \"")), rng.choice(("YOUR_API_KEY_HERE_123", "changeme", "xxxxxxxxxxxxxxxxxxxx1", "example-token-0000", "<insert_key_1>", "placeholder", "test1234test1234", "required", "undefined", "os.environ", "process.env.TOKEN"))) if kind == 7
            else (rng.choice(("token: ", "password = ", "secret: ")), rng.choice(DICTIONARY) + rng.choice(("", "_", ".")) + rng.choice(DICTIONARY)) if kind == 8
            else ("", "_".join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 5))) + str(rng.randint(0, 99))) if kind == 9
            else ("", "=" * rng.randint(8, 40) + str(rng.randint(0, 9)) + "-" * rng.randint(8, 30))
        )

    out = []
    for k in range(n):
        before, value = secret() if k % 2 else plain()
        around = words if rng.random() < 0.5 else odd
        head = around(rng.randint(0, 6))
        head += " " * bool(head) + before
        tail = rng.choice(("\"", "'", "", "")) + " "
        if not k % 2 and rng.random() < 0.2:
            tail += rng.choice(("(sha256) ", "is the commit ", "(checksum) ", "[build id] ", "md5 "))
        tail += around(rng.randint(0, 6))
        path = rng.choice(("src/app.py", "config/settings.yml", ".env", "src7", "src12", "web/page", "")) if k % 2 or rng.random() < 0.7 else rng.choice(("tests/data.json", "docs/readme.md", "package-lock.json", "examples/run.sh"))
        out.append((head + value + tail, len(head), len(head) + len(value), path, k % 2))
    return out


class Forest:
    """Trees of (feature, threshold, left, right) and leaves of a probability, as plain arrays."""

    def __init__(self, trees: list[list[tuple]]) -> None:
        self.trees = trees

    def score(self, row: list[float]) -> float:
        total = 0.0
        for tree in self.trees:
            k = 0
            while tree[k][0] >= 0:
                feature, threshold, left, right = tree[k]
                k = left if row[feature] <= threshold else right
            total += tree[k][1]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """A tree by the Gini impurity, from a few features and thresholds at each node."""
    nodes: list[tuple] = []
    tries = max(1, round(math.sqrt(x.shape[1])))

    def build(own: np.ndarray, depth: int) -> int:
        k, p = len(nodes), float(y[own].mean())
        nodes.append((-1, p))
        if depth == 0 or len(own) < 2 * LEAF or p in (0.0, 1.0):
            return k
        best = (2 * p * (1 - p) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], tries, replace=False):
            values = x[own, f]
            for t in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 15), method="lower")):
                low = values <= t
                n = int(low.sum())
                if LEAF <= n <= len(own) - LEAF:
                    a, b = y[own[low]].mean(), y[own[~low]].mean()
                    gini = (n * 2 * a * (1 - a) + (len(own) - n) * 2 * b * (1 - b)) / len(own)
                    if gini < best[0]:
                        best = (gini, int(f), float(t))
        if best[1] is None:
            return k
        low = x[own, best[1]] <= best[2]
        left, right = build(own[low], depth - 1), build(own[~low], depth - 1)
        nodes[k] = (best[1], best[2], left, right)
        return k

    build(np.arange(len(y)), DEPTH)
    return nodes


def train(rows: list[tuple[str, int, int, str, int]], seed: int = 5) -> list[list[tuple]]:
    """The trees of a forest from labelled findings."""
    if not rows or len({r[4] for r in rows}) < 2:
        return [[(-1, float(np.mean([r[4] for r in rows])) if rows else 0.5)]]
    make = Features()
    x, y = np.array([make.of(*r[:4]) for r in rows]), np.array([float(r[4]) for r in rows])
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(TREES):
        own = rng.integers(0, len(y), len(y))
        out.append(grow(x[own], y[own], rng))
    return out


def train_on(labelled: DataFrame, size: int = SAMPLE) -> list[list[tuple]]:
    """The trees of a forest from a table (text, start, end, path, secret), at most size rows of it."""
    rows = labelled.select("text", "start", "end", F.coalesce("path", F.lit("")), F.col("secret").cast("int")).filter("text is not null and secret is not null")
    return train([tuple(r) for r in rows.orderBy(F.xxhash64("text", "start", "end")).limit(size).collect()])


FIELDS = T.StructType(
    [
        T.StructField("n_candidates", T.LongType(), False),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])), False),
        T.StructField("redacted", T.StringType(), False),
    ]
)


def find_secrets(docs: DataFrame, trees: list[list[tuple]] | None = None, text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (row, out): out has the number of candidates, the spans kept (code points) and the text with MARK in their place."""
    given = docs.sparkSession.sparkContext.broadcast(trees if trees is not None else train(findings()))
    inputs = [text_col, path_col] if path_col and path_col in docs.columns else [text_col]

    def make():
        forest, features = Forest(given.value), Features()

        def work(column, paths=None):
            numbers, spans, out = [], [], []
            for k, text in enumerate(texts(column)):
                found = candidates(text)
                numbers.append(len(found))
                kept = []
                if found:
                    path = str(paths[k].as_py() or "") if paths is not None else ""
                    kept = [(a, b, s) for a, b in found if (s := forest.score(features.of(text, a, b, path))) >= threshold]
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in kept])
                if kept:
                    ends = [0, *(e for _, e, _ in kept)]
                    text = MARK.join([text[e:a] for e, (a, _, _) in zip(ends, kept)] + [text[ends[-1] :]])
                out.append(text)
            return numbers, spans, out

        return work

    return annotate(docs, inputs, make, FIELDS)


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with secrets replaced, and their number of code points where the column is there; a null text stays null."""
    found = find_secrets(docs, text_col=text_col)
    text = F.when(F.col(f"row.{text_col}").isNotNull(), F.col("out.redacted"))
    changed = {text_col: text}
    if size_col in docs.columns:
        own = F.col(f"row.{size_col}")
        changed[size_col] = F.when(F.size("out.spans") == 0, own).otherwise(F.char_length("out.redacted").cast(docs.schema[size_col].dataType))
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents by the forest of the made findings. Every row has a row; see the module for odd texts."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    line = F.transform("out.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("out.n_candidates").alias("n_candidates"),
        F.size("out.spans").cast("long").alias("n_secrets"),
        F.concat_ws(",", line).alias("spans"),
        F.sha2("out.redacted", 256).alias("redacted_sha256"),
    )
