"""Operator 2: secrets in every version of a file, by an incremental ledger of blobs.

Method: a version is addressed by the SHA-256 of its content. The ledger has, for each blob, the rule versions that it
was scanned with and what they found. Only blobs with a rule version not yet in the ledger are scanned, and only for
these; findings are then joined back to all paths with that content. A blob that a third of all paths share is one row
for each task before the shuffle and is scanned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import common, worker


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: Strings of which a lower-cased text must have one for the pattern to match at all; none: it is always tried.
    needs: tuple[str, ...] = ()
    flags: int = 0
    #: The group that must have at least so many characters; shorter matches are dropped.
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str, lowered: str) -> list[tuple[int, int]]:
        if self.needs and not any(s in lowered for s in self.needs):
            return []
        return [m.span() for m in _compiled(self).finditer(text) if len(m[self.group]) >= self.least]


_patterns: dict[Rule, re.Pattern] = {}


def _compiled(rule: Rule) -> re.Pattern:
    if rule not in _patterns:
        _patterns[rule] = re.compile(rule.pattern, rule.flags)
    return _patterns[rule]


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.IGNORECASE | re.ASCII, 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), 0, 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", ()),  # a run of fewer digits would fail, and runs don't overlap
)
#: A private key through its END line (before another key begins), or where that is missing through its headers and
#: lines of base64; line ends may be written as escapes.
_LINE = r"(?:[\s\"'+,]|\\[nrt])"
_PEM = (
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1-----"
    rf"|(?:{_LINE}+[A-Z][A-Za-z-]+: [^\n\\]*)*(?:{_LINE}+[A-Za-z0-9/][A-Za-z0-9+/]{{15,}}={{0,2}})*(?:(?<=[A-Za-z0-9+/]{{16}}){_LINE}+[A-Za-z0-9+/]{{1,15}}={{0,2}}(?=[ \t\"']*(?:[\r\n\\]|$)))?)"
)
#: Further kinds of this library's own.
MORE = (
    Rule("pem", 2, _PEM, ("private key-----", "private key block-----")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", ("eyj",)),
    Rule("forge", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-")),
    Rule("chat", 1, r"xox[abeprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,200}:[^\s/@]{1,200}@", ("://",)),
)
RULES = BASE + MORE
LEDGER = "blob binary, rules array<string>, spans array<struct<start:int,rank:int,kind:string,end:int,rule:string>>"
_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("rule", pa.string())])


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of all matches in the order of start and kind; code points, end exclusive."""
    lowered = text.lower()
    return sorted((a, k, r.kind, b) for k, r in enumerate(rules) for a, b in r.spans(text, lowered))


def read_ledger(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(*paths) if paths else spark.createDataFrame([], LEDGER)


def extend_ledger(docs: DataFrame, ledger: DataFrame | None, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scans what ledger (None: nothing so far) doesn't have, writes it to path and returns these new ledger rows."""
    blobs = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        pending = blobs.withColumn("pending", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        pending = blobs.join(seen, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("seen", F.array()))).filter("size(pending) > 0")
    rank = {r.key: (k, r) for k, r in enumerate(rules)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("secrets")
        for batch in batches:
            for part in common.slices(batch, 1):
                out = []
                for text, keys in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lowered = text.lower()
                    found = sorted((a, rank[key][0], rank[key][1].kind, b, key) for key in keys for a, b in rank[key][1].spans(text, lowered))
                    out.append([dict(zip(("start", "rank", "kind", "end", "rule"), x, strict=True)) for x in found])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out, pa.list_(_SPAN))], names=["blob", "rules", "spans"])

    return common.written(pending.select("blob", "text", "pending").mapInArrow(run, LEDGER), path)


def spans_of_blobs(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans of the blobs in which these rules found something, spans in the order of start and of these rules.

    What other rules or versions found is left out. Spans of a ledger written without their rule belong to the version
    of their kind that their row was scanned with.
    """
    known = F.array(*(F.lit(r.key) for r in rules))
    rule = lambda s: F.coalesce(s["rule"], F.get(F.filter("rules", lambda r: F.startswith(r, F.concat(s["kind"], F.lit("@")))), F.lit(0)))
    wanted = F.filter("spans", lambda s: F.array_contains(known, rule(s)))
    rows = ledger.select("blob", F.transform(wanted, lambda s: F.struct(s["start"].alias("start"), F.array_position(known, rule(s)).cast("int").alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("spans"))
    rows = rows.filter(F.size("spans") > 0)
    return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, path: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    A null text counts as empty; a text without findings has counts of 0, the hash of an empty string and empty spans.
    Repeated rows and null ids all stay. Other columns of docs aren't read. New ledger rows are written to path, the
    findings joined to the paths beside it.
    """
    new = extend_ledger(docs, ledger, path, rules, text_col)
    # Written, so that both sides of the join are dealt out anew and Spark can split a blob that very many paths have.
    found = common.written(spans_of_blobs(new if ledger is None else ledger.unionByName(new), rules), f"{path}-found")
    paths = docs.select(F.col(id_col).alias("doc_id"), blob_of(F.col(text_col)).alias("blob"))
    rows = paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array()))
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts, spans, strict=True):
        text, parts, at = text.as_py(), [], 0
        for s in found.as_py():
            if s["end"] > at:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"<{s['kind']}>"]
                at = s["end"]
        out.append("".join(parts) + text[at:])
    return pa.array(out, pa.string())


def redacted(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """The rows of docs with every secret replaced by its kind; length_col, if given, gets the new number of characters.

    Null texts and texts without findings stay as they are, repeated rows too. What ledger knows isn't scanned again.
    """
    new = extend_ledger(docs, ledger, path, rules, text_col)
    found = common.written(spans_of_blobs(new if ledger is None else ledger.unionByName(new), rules), f"{path}-found")
    blob, spans = common.free_name(docs, "blob"), common.free_name(docs, "found_spans")
    rows = docs.withColumn(blob, blob_of(F.col(text_col))).join(found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")
    hit = rows.filter(F.col(spans).isNotNull()).withColumn(text_col, _redacted(F.col(text_col), F.col(spans)))
    if length_col:
        hit = hit.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    clean = rows.filter(F.col(spans).isNull())
    return clean.select(*docs.columns).unionByName(hit.select(*docs.columns))
