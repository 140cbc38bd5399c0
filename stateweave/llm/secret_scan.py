"""Secret scans: fixed patterns, and strings whose zstandard novelty is high in a sensitive context.

Base spans come from three patterns (assign, access, hex). The method adds spans of kind ``novel``: every run of 16 or
more characters of a secret's alphabet near a sensitive keyword, on either side, is a candidate, and so is every one that
adjoins such a run with only a ``JOINT`` between them (lines of one key, dotted parts of one token); its marginal cost is the bytes that a
zstandard frame, primed with a dictionary of identifiers and usual code words, grows by when the candidate follows the
text around it. Candidates that cost at least ``MIN_COST`` of their length are incompressible and reported, unless a base
span touches them. Offsets are code points, ends exclusive.

Defined results: null and empty texts have no spans; a null doc_id is kept; texts of any length are scanned whole; repeated rows
repeat; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Kinds in the order of ties, and their patterns and least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
SENSITIVE = (
    "access", "auth", "bearer", "cert", "client", "connection", "cookie", "cred", "jwt", "key", "login", "oauth", "passphrase",
    "passwd", "password", "private", "pwd", "secret", "session", "sign", "token", "webhook",
)
IDENTIFIERS = (
    "abstract access account address admin algorithm allocate amount application argument array assert async attribute "
    "authentication authorization available backend background base64 batch binary boolean buffer build cache callback "
    "certificate channel character checksum class client cluster column command commit component config configuration "
    "connection constant constructor container content context controller cookie count create credential current customer "
    "database dataset default define delete deploy description destination development device directory display document "
    "domain download element email enable encoding encrypt endpoint engine entity environment error event example exception "
    "execute export expression extension external false field filename filter firewall folder format framework function "
    "gateway generate global group handler hardware hash header hidden history hostname https identifier image implement "
    "import include index initialize input insert instance integer interface internal iterator javascript kernel keyword "
    "language length library license listener loader local localhost location logger login manager master memory message "
    "metadata method middleware migration module monitor mutable namespace network notification number object operation "
    "optional option organization origin output override package parameter parent parse password path pattern payload "
    "permission pipeline platform plugin pointer policy port position postgres prefix private process production profile "
    "project property protocol provider proxy public python query queue random record redirect reference region register "
    "release remote render repository request require resource response result return return_value role route runtime sample "
    "schedule schema script search secret section secure select sequence serialize server service session setting shared "
    "signature source staging standard static status storage stream string struct subscription success suffix system table "
    "target template temporary test thread throw timeout timestamp token trace transaction transfer transform true type "
    "undefined unique update upload username utils validate value variable vector version virtual volume warning webhook "
    "window worker workflow wrapper"
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CONTEXT = 64
#: What may part candidates of one secret: a dot, or a line's end with its quotes and indent.
JOINT = re.compile(r"\.|[\x20\t\"',\\+]{0,8}(?:\r?\n|\\n)[\x20\t\"'>#*]{0,24}")
MIN_COST = 0.7


class Novelty:
    """Marginal compressed bytes of a string after its context, under the primed dictionary."""

    def __init__(self):
        words = IDENTIFIERS.split()
        camel = "".join(w.capitalize() for w in words)
        primed = zstandard.ZstdCompressionDict((IDENTIFIERS + " " + "_".join(words) + " " + camel).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.codec = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def cost(self, around: str, candidate: str) -> float:
        """Bytes the candidate adds, a character."""
        before = around.encode()
        return (len(self.codec.compress(before + candidate.encode())) - len(self.codec.compress(before))) / len(candidate)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[str, int, int]]:
    low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    if not any(k in low for k in SENSITIVE):
        return []
    spans = [m.span() for m in CANDIDATE.finditer(text)]
    near = [any(k in low[max(0, start - CONTEXT) : start] or k in low[end : end + CONTEXT] for k in SENSITIVE) for start, end in spans]
    # a context carries on over adjoining candidates, both ways
    joint = [JOINT.fullmatch(text, e, s) is not None for (_, e), (s, _) in zip(spans, spans[1:], strict=False)]
    for k in range(1, len(spans)):
        near[k] |= near[k - 1] and joint[k - 1]
    for k in range(len(spans) - 1, 0, -1):
        near[k - 1] |= near[k] and joint[k - 1]
    out = []
    for (start, end), sensitive in zip(spans, near, strict=True):
        body = text[start:end]
        if not sensitive or not (re.search(r"[0-9]", body) and re.search(r"[A-Za-z]", body)) or any(s < end and start < e for _, s, e in base):
            continue
        if novelty.cost(text[max(0, start - CONTEXT) : start] + text[end : end + CONTEXT], body) >= MIN_COST:
            out.append(("novel", start, end))
    return out


def all_spans(text: str | None, novelty: Novelty) -> list[tuple[str, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty), key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each run of spans that touch replaced by ``mark``."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found`` (array of kind, start, end) for each row."""

    def make():
        novelty = Novelty()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in all_spans(t, novelty)] for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(text(F.filter("found", lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with every span redacted; all documents stay."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def make():
        novelty = Novelty()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([redact(t, all_spans(t, novelty)) for t in batch.column("text").to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)

        return work

    out = map_rows(docs, make, schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
