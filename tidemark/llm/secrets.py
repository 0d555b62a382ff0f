"""Secrets in texts: broad candidates, and a random forest that removes false positives.

Candidates are runs of at least ten characters that keys and tokens are made of and that hold a digit or
begin as keys of known services do, whatever is assigned to a name like password or token or one that holds it
(DB_PASSWORD), and passwords in URLs. The forest sees a candidate's length, its
character classes and transitions (how often classes change, how likely its letter pairs are in words),
how much of it dictionary words cover, words of the path, and the words and signs before and after it.
It is trained on labelled findings: (before, candidate, after, path, label); :func:`labelled_findings`
gives a default set of fixed size, made by rule, and a user passes their own.

Each text is scanned whole, in one pass without a shuffle. A finding names its place, not its text.

Defined cases. Null and empty texts and paths have no candidates, or no path words. Repeated rows give
repeated findings. A null doc_id is carried along. Other columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.trees import Forest

#: How keys of well-known services begin.
_PREFIXES = r"(?:AKIA|ASIA)[A-Z0-9]{16}\b|gh[pousr]_|sk_live_|xox[abprs]-|glpat-"
_NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|credential|(?:api|access|auth|private|secret)[_\- ]?key|bearer|authorization"
#: A name, also inside a longer one: DB_PASSWORD, aws_secret_access_key.
_NAME = rf"(?<![a-z])(?:{_NAMES})(?![a-z])[a-z0-9_\-]{{0,40}}"
_CANDIDATE = re.compile(
    r"://[^\s:/@\"'<>]*:(?P<url>[^\s/@\"'<>]{3,})(?=@[A-Za-z0-9\[])"
    rf"|(?i:{_NAME}[\"']?\s*(?:[:=]|=>|is)\s*[\"']?)(?P<set>[^\s\"',;]{{6,}})"
    rf"|(?<![A-Za-z0-9+/_.@\-])(?=[A-Za-z+/_\-]*\d|{_PREFIXES})(?P<run>[A-Za-z0-9+/_\-]{{10,}}={{0,2}})(?![@\w])"
)
_NAMED = re.compile(rf"(?i){_NAME}[\"']?\s*(?:[:=]|=>|is)?\s*[\"']?$|://[^\s:/@\"'<>]*:$")
_PREFIX = re.compile(_PREFIXES)
_PATH = re.compile(r"(?i)test|spec|example|sample|doc|fixture|mock|vendor|\.lock|\.md|\.svg|\.css")
_CONFIG = re.compile(r"(?i)\.env|config|settings|\.ya?ml|\.properties|\.ini|\.tf|credential|secret")
_DIGEST = re.compile(r"(?i)\b(?:sha\d*|md5|commit|rev|revision|hash|digest|checksum|etag|uuid|guid|id|ref|isbn|build|version)\b[\"']?\s*[:=#]?\s*[\"']?$")
_HOLDER = re.compile(r"(?i)x{4,}|\*{3,}|example|placeholder|your|change|dummy|sample|redacted|<|\$\{|\{\{|test|todo|none|null|true|false|1234")
CONTEXT = 40

#: Common words for dictionary coverage.
WORDS = (
    "about access account address admin after again alpha also application array back base before beta between block "
    "board body build button cache call change check class click client cloud code color column common config "
    "content control core count create current data date default delete demo design detail device display document "
    "download edit element email error event example field file filter first folder form format from function general "
    "get group handle header height help home host html image import index info input insert item json key label "
    "language last layer layout length level library license line link list local login main manager map master menu "
    "message method mode model module month more name network node number object option order other output package "
    "page panel parent part password path person phone place platform plugin point post preview print process product "
    "profile program project public query read record release remove report request reset resource response result "
    "right role root row sample save schema screen script search second secret section select send server service "
    "session set settings show side sign simple size source start state status step stop storage store string style "
    "submit summary support switch system table tag target task template test text that the theme this time title "
    "toggle token tool top track type unit update upload user value version video view warning web week width window "
    "with word work world year your"
).split()
_WORDS = sorted((w for w in WORDS if len(w) > 3), key=len, reverse=True)


def _pair_scores() -> dict[str, float]:
    """Log probabilities of letter pairs in :data:`WORDS`."""
    counts = np.ones((27, 27))
    for word in WORDS:
        at = [26, *(ord(c) - 97 for c in word), 26]
        for a, b in zip(at, at[1:], strict=False):
            counts[a, b] += 1
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return {chr(97 + a) + chr(97 + b): float(logs[a, b]) for a in range(26) for b in range(26)}


_CLASS = {c: 0 for c in string.ascii_lowercase} | {c: 1 for c in string.ascii_uppercase} | {c: 2 for c in string.digits}


def features(before: str, candidate: str, after: str, path: str, pairs: dict[str, float], named: bool = False) -> tuple:
    """``named``: known to follow a name, or a user's name in a URL, however far back that begins."""
    n = max(1, len(candidate))
    kinds = [_CLASS.get(c, 3) for c in candidate]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    counts: dict[str, int] = {}
    for c in candidate:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = candidate.lower()
    scores = [pairs[p] for a, b in zip(low, low[1:], strict=False) if (p := a + b) in pairs]
    rest, covered = low, 0
    for word in _WORDS:
        if word in rest:
            covered += len(word) * rest.count(word)
            rest = rest.replace(word, "\0")
    return (
        len(candidate),
        changes / n,
        sum(k == 0 for k in kinds) / n,
        sum(k == 1 for k in kinds) / n,
        sum(k == 2 for k in kinds) / n,
        sum(k == 3 for k in kinds) / n,
        entropy,
        sum(scores) / len(scores) if scores else -6.0,
        covered / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate))),
        float(named or bool(_NAMED.search(before))),
        float(bool(_DIGEST.search(before))),
        float(bool(_HOLDER.search(candidate))),
        float(bool(_PREFIX.match(candidate))),
        float(before[-1:] in "\"'=:"  and before != ""),
        float(after[:1] in "\"'" and after != ""),
        float(bool(re.search(r"(?i)base64,$|https?:\S*$|[/\\.]$", before))),
        float(bool(_PATH.search(path))),
        float(bool(_CONFIG.search(path))),
    )


def labelled_findings(seed: int = 23, each: int = 24) -> list[tuple[str, str, str, str, int]]:
    """(before, candidate, after, path, label): ``each`` of a few kinds of secrets and of what looks like them."""
    random = np.random.default_rng(seed)

    def draw(alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(random.choice(list(alphabet), int(random.integers(low, (high or low) + 1))))

    def pick(*options: str) -> str:
        return options[int(random.integers(len(options)))]

    def word() -> str:
        return pick(*WORDS)

    letters, digits, hexa = string.ascii_letters, string.digits, "0123456789abcdef"
    alnum, base = letters + digits, letters + digits + "+/"
    paths = ("", "src0", "src12", "web/app.py", "deploy/config.yaml", ".env", "notes.txt", "docs/guide.md", "tests/test_app.py")
    out = []
    for _ in range(each):
        said, name = f"{word()} {word()} ", pick("password", "token", "secret", "api_key", "Password", "access_key", "auth token")
        sign, quote = pick("=", " = ", ": ", ":"), pick("", '"', "'")
        end = f" {word()} {word()}"
        true = [
            (said, "AKIA" + draw(string.ascii_uppercase + digits, 16), end),
            (said, "AKIA" + draw(string.ascii_uppercase, 16), end),
            (f"aws_access_key_id{sign}", "AKIA" + draw(string.ascii_uppercase + "234567", 16), end),
            (f"{said}{name}{sign}{quote}", draw(hexa, 16, 24), f"{quote}{end}"),
            (f'{said}{name}{sign}{quote or chr(34)}', draw(hexa, 32, 64), f"{quote or chr(34)}{end}"),
            (f"{said}{name}{sign}{quote}", draw(base, 20, 44), f"{quote}{end}"),
            (f"{said}{name}{sign}{quote}", draw(alnum + "!#%_", 9, 16) + draw(digits, 1), f"{quote}{end}"),
            (said, pick("ghp_", "sk_live_", "xoxb-", "glpat-") + draw(alnum, 24, 36), end),
            (f"{said}Authorization: Bearer ", draw(alnum + "_-", 30, 60), end),
            (f"{said}", draw(base, 40) + "=", end),
        ]
        camel = word() + word().title() + word().title() + draw(digits, 1, 2)
        false = [
            (said, draw(digits, 13, 19), end),
            (said, draw(digits, 10, 12), end),
            (said, f"{draw(digits, 3)}-{draw(digits, 3)}-{draw(digits, 4)}", end),
            (f"{said}{pick('commit', 'revision', 'sha256:', 'md5', 'digest:', 'checksum=')} ".replace(": ", ":").replace("= ", "="), draw(hexa, 40), end),
            (f"{said}{pick('id', 'uuid', 'ref')}{sign}", "-".join((draw(hexa, 8), draw(hexa, 4), draw(hexa, 4), draw(hexa, 4), draw(hexa, 12))), end),
            (said, camel, end),
            (said, f"{word()}_{word()}_{word()}{draw(digits, 1, 3)}", end),
            (said, f"{word()}-{word()}-{draw(digits, 1, 4)}", end),
            (said, f"20{draw(digits, 2)}-0{draw('123456789', 1)}-1{draw(digits, 1)}{pick('', 'T120000Z', '_1230')}", end),
            (f"{said}{name}{sign}{quote}", pick("your_password", "changeme", "xxxxxxxxxx", "example_token", "${TOKEN}", "<password>", "********", "placeholder1", "my_secret_key", "test1234"), f"{quote}{end}"),
            (f"{said}{name}{sign}", word() + pick("", ".", "()", "_" + word()), end),
            (f"{said}https://{word()}.com/", f"{word()}/{word()}{draw(digits, 2, 6)}", end),
            (f"{said}data:image/png;base64,", draw(base, 60, 90), end),
            (said, f"{word()}/{word()}/{word()}{draw(digits, 1)}", end),
            (said, f"+{draw(digits, 11)}", end),
        ]
        out += [(*f, pick(*paths), 1) for f in true] + [(*f, pick(*paths), 0) for f in false]
    # Names inside longer ones, and passwords in URLs.
    signs = alnum + "!#%&$^*?"
    for _ in range(each):
        said, end = f"{word()} {word()} ", f" {word()} {word()}"
        name = pick("DB_PASSWORD", "client_secret", "MY_API_KEY", "aws_secret_access_key", "github_token", "SMTP_PASSWD", "redis-password")
        sign, quote = pick("=", " = ", ": ", ":"), pick("", '"', "'")
        user = f"{said}{pick('postgres', 'https', 'amqp', 'mongodb+srv', 'redis')}://{pick(word(), 'root', 'admin', '')}:"
        host = f"@{word()}.{word()}.com/{word()}{end}"
        true = [
            (f"{said}{name}{sign}{quote}", draw(signs, 8, 15), f"{quote}{end}"),
            (f"{said}{name}{sign}{quote}", draw(letters, 5) + draw(digits, 1) + draw(letters, 2) + draw("!#%&$^*?", 1) + draw(digits, 1), f"{quote}{end}"),
            (f"{said}{name}{sign}{quote}", draw(letters, 8, 14), f"{quote}{end}"),
            (f"{said}{name}{sign}{quote}", draw(base, 30, 44), f"{quote}{end}"),
            (f"{said}{name}{sign}{quote}", draw(hexa, 16, 40), f"{quote}{end}"),
            (user, draw(signs, 8, 16), host),
            (user, draw(letters, 8, 14), host),
        ]
        false = [
            (f"{said}{name}{sign}{quote}", pick("your_password", "changeme", "xxxxxxxxxx", "${DB_PASSWORD}", "<secret>", "********", "placeholder1"), f"{quote}{end}"),
            (f"{said}{name}{sign}", word() + pick("", ".", "()", "_" + word()), end),
            (user, pick("password", "changeme", "${DB_PASSWORD}", "xxxxxxxx", "your_password", "example"), host),
        ]
        out += [(*f, pick(*paths), 1) for f in true] + [(*f, pick(*paths), 0) for f in false]
    return out


class Scanner:
    def __init__(self, findings: list[tuple[str, str, str, str, int]]):
        self.pairs = _pair_scores()
        rows = np.array([features(b[-CONTEXT:], c, a[:CONTEXT], p, self.pairs) for b, c, a, p, _ in findings])
        self.forest = Forest(rows, np.array([f[4] for f in findings], dtype=float))

    def scan(self, text: str | None, path: str | None) -> Iterator[tuple[int, int, str, float]]:
        """(first code point, code points, digest, score) of each candidate."""
        for m in _CANDIDATE.finditer(text or ""):
            group = m.lastgroup
            begin, end = m.span(group)
            found = m[group]
            before, after = text[max(0, begin - CONTEXT) : begin], text[end : end + CONTEXT]
            row = features(before, found, after, path or "", self.pairs, group != "run")
            yield begin, end - begin, hashlib.sha256(found.encode()).hexdigest(), self.forest.score(row)


def scan_secrets(
    documents: DataFrame,
    path: str = "source",
    findings: list[tuple[str, str, str, str, int]] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """(doc_id, begin, length, sha256, score, secret) for every candidate in ``documents`` (doc_id, text
    and the column named by ``path``)."""
    scanner = Scanner(findings or labelled_findings())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                rows, found = [], []
                for k, (text, where) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for finding in scanner.scan(text, where):
                        rows.append(k)
                        found.append(finding)
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.string()),
                        pa.array(columns[3], pa.float64()),
                    ],
                    names=["doc_id", "begin", "length", "sha256", "score"],
                )

    plain = documents.select("doc_id", F.col("text").cast("string"), F.col(path).cast("string"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, begin long, length long, sha256 string, score double").withColumn(
        "secret", F.col("score") >= threshold
    )
