"""Secret scan with an incremental ledger of blobs.

Every version of a document is addressed by the SHA-256 of its content (its
blob).  The ledger keeps which blob was scanned with which version of which
rule, and what was found.  A run scans only pairs of blob and rule version that
the ledger lacks, each once however many paths (documents, or documents and
versions) hold the blob, adds them to the ledger, and joins the findings back to
all paths.  A secret itself is never kept: a finding has the SHA-256 of it.

``query`` and the pipeline keep a ledger for each folder of tables in the shared
folder.  The ledger only grows: pairs are written after what was found in them,
so a run that breaks off is repeated and not believed, and two runs at once at
worst scan a pair twice and find the same.

All matching stays in the JVM.  A rule names literal anchors one of which each
of its matches contains; texts without them never reach the regular expression
and are never moved.

Defined results: a null text has no blob and no findings; an empty one is a
blob without findings.  A text of any length is read whole; of matches of one
rule that overlap the first counts.  Rows that repeat give their findings once
for each distinct path and blob; a null doc_id keeps its findings, under null.
An empty table gives no findings.  Other columns of ``docs`` are ignored by
``scan`` and kept by ``redact``.  A private key reaches from its BEGIN line to
the next END line of a private key, or to the text's end where none follows.
An assigned token counts only in quotes, an assigned password also without.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K


@dataclass(frozen=True)
class Rule:
    """``pattern`` is RE2's; its first group is the secret. A changed pattern needs a new version.

    A ``\\b`` at its beginning or end is one between ASCII characters; as Java's
    isn't, ``java`` looks around instead.  Where ``any_case``, the anchors are in
    lower case and those of the lower-case text.
    """

    name: str
    version: int
    pattern: str
    anchors: tuple[str, ...]
    any_case: bool = False

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"

    @property
    def java(self) -> str:
        out = "(?<![0-9A-Za-z_])" + self.pattern[2:] if self.pattern.startswith(r"\b") else self.pattern
        return out[:-2] + "(?![0-9A-Za-z_])" if out.endswith(r"\b") else out


def _assigned(names: tuple[str, ...], value: str) -> str:
    """The pattern of a value given to a name of these, in any case, that may go on and be quoted.

    It goes on by a separator, a digit, a capital or a plural's s, so a tokenizer is no token.
    Letters are spelt out, as the engines fold case differently.
    """
    any_case = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in names)
    return rf"""(?:{any_case})[sS]?(?:[_\-0-9A-Z][0-9A-Za-z_\-]{{0,{NAME_SUFFIX}}})?\\?["']?[ \t]*(?::=|=>|[=:])[ \t]*""" + value


#: Characters that a name may go on for after the word that makes it a secret's, and one more.
NAME_SUFFIX = 80

RULES = (
    Rule("private_key", 2, r"(-----BEGIN [0-9A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END [0-9A-Z ]*PRIVATE KEY(?: BLOCK)?-----|[\s\S]*))", ("PRIVATE KEY",)),  # first: no other rule may cut its frame in redact()
    Rule("aws_access_key", 1, r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", ("AKIA", "ASIA")),
    Rule("assigned_token", 2, _assigned(("token", "api_key", "api-key", "apikey", "secret"), r"""\\?["']([0-9A-Za-z_\-+/=]{20,})\\?["']"""), ("token", "api_key", "api-key", "apikey", "secret"), True),
    Rule("assigned_password", 2, _assigned(("password", "passwd"), r"""\\?["']?([0-9A-Za-z!#$%&*+\-./?@^_~]{8,})"""), ("password", "passwd"), True),
    Rule("code_host_token", 1, r"(gh[pousr]_[0-9A-Za-z]{36})", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, r"(xox[abprs]-[0-9A-Za-z\-]{10,})", ("xox",)),
    Rule("maps_key", 1, r"(AIza[0-9A-Za-z_\-]{35})", ("AIza",)),
    Rule("web_token", 1, r"(eyJ[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,})", ("eyJ",)),
)

#: Flagged blobs up to this number are broadcast to the documents; more are joined by shuffling.
BROADCAST_BLOBS = 200_000

_SCANNED = "blob string, rule string"
_FOUND = "blob string, rule string, secret_sha256 string"


def _anchored(rule: Rule, text: Column) -> Column:
    within = F.lower(text) if rule.any_case else text
    return reduce(Column.__or__, [F.contains(within, F.lit(a)) for a in rule.anchors])


def _read(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    if path:
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def blobs(docs: DataFrame, path: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``path`` and ``blob`` of all paths with content."""
    return docs.filter("text IS NOT NULL").select(*path, F.sha2("text", 256).alias("blob"))


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, blob, rule, secret_sha256) of all distinct findings; brings the ledger (a folder) up to date.

    ``path`` are the columns that name a version of a document, such as doc_id
    and version.  Without a ledger all blobs are new, and what is found goes to
    the shared folder.
    """
    spark = docs.sparkSession
    every = F.array(*(F.lit(r.id) for r in rules))
    paths = blobs(docs, path)
    one = paths.select("blob").distinct()
    if ledger:
        seen = _read(spark, f"{ledger}/scanned", _SCANNED).filter(F.col("rule").isin([r.id for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = one.join(seen, "blob", "left").withColumn("todo", F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen"))).filter(F.size("todo") > 0).drop("seen")
        todo = K.cut(todo)
    else:
        todo = one.withColumn("todo", every)
    anywhere = reduce(Column.__or__, [_anchored(r, F.col("text")) for r in rules])
    # of equal texts, of which there may be many, one is moved
    texts = docs.filter(F.col("text").isNotNull() & anywhere).select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    found = texts.join(todo, "blob").select("blob", F.inline(F.concat(*(_hits(r) for r in rules)))).distinct()
    if ledger:
        found = K.cut(found)
        found.write.mode("append").parquet(f"{ledger}/found")
        todo.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{ledger}/scanned")  # last
        found = _read(spark, f"{ledger}/found", _FOUND).filter(F.col("rule").isin([r.id for r in rules])).distinct()
    else:
        found = K.cut(found)
    return paths.join(found, "blob").select(*path, "blob", "rule", "secret_sha256").distinct()


def ledger_of(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the ledger of a folder of tables."""
    return f"{K.shared_dir(spark)}/secret-ledger-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def _hits(rule: Rule) -> Column:
    """What the rule finds in a text, where it is among the rules to do."""
    found = F.transform(F.regexp_extract_all("text", F.lit(rule.java), F.lit(1)), lambda s: F.struct(F.lit(rule.id).alias("rule"), F.sha2(s, 256).alias("secret_sha256")))
    none = F.array().cast("array<struct<rule:string,secret_sha256:string>>")
    return F.when(_anchored(rule, F.col("text")) & F.array_contains("todo", rule.id), found).otherwise(none)


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``[rule]``; ``n_chars`` follows where it is a column."""
    flagged = K.cut(scan(docs, ledger, rules).select("blob").distinct())
    few = flagged.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS
    blob, mark = K.spare(docs, "_blob", "_flagged")
    text = F.col("text")
    for r in rules:
        begin, end = _first_group(r.java)
        head, body, tail = r.java[:begin], r.java[begin:end], r.java[end:]
        text = F.regexp_replace(text, f"({head}){body}({tail})", f"$1[{r.name}]$3")
    marked = flagged.select(F.col("blob").alias(blob), F.lit(True).alias(mark))
    joined = docs.withColumn(blob, F.sha2("text", 256)).join(F.broadcast(marked) if few else marked, blob, "left")
    out = {"text": F.when(F.col(mark), text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(mark), F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(out).select(*docs.columns)


def _first_group(pattern: str) -> tuple[int, int]:
    """Where the first capturing group of ``pattern`` begins and ends."""
    start, depth, within, k = -1, 0, False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif within:
            within = c != "]"
        elif c == "[":
            within = True
        elif c == "(":
            if start < 0 and pattern[k + 1] != "?":
                start = k
                depth = 0
            if start >= 0:
                depth += 1
        elif c == ")" and start >= 0:
            depth -= 1
            if not depth:
                return start, k + 1
        k += 1
    raise ValueError(f"no group in {pattern}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(K.table(spark, sf_dir, "documents"), ledger_of(spark, sf_dir))


def _oracle() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, sha256(text) AS blob, '{r.id}' AS rule, unnest(regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}', 1)) AS secret FROM documents WHERE text IS NOT NULL" for r in RULES)
    return f"SELECT DISTINCT doc_id, blob, rule, sha256(secret) AS secret_sha256 FROM ({parts})"


ORACLE = _oracle()
