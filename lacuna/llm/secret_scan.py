"""Secret scans by multipart credential linking.

A credential has parts: an access identifier, a secret, an endpoint. Strong parts (the base patterns) are always
reported. Weak parts are reported only where parts that complete them stand in the same scope, an interval of
``radius`` code points before its start and after its end. The interval join is a running maximum over each text's parts:
no pairs are made, and a text with many parts costs its length, not its square.

Defined cases: a null text counts as empty; an empty table gives no rows; each input row gives one row, so repeated
rows and repeated or null ids stay apart; other columns of the input are ignored; parts of equal start are ordered by
the list KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.spans import SPAN, let, no_spans, scan, spans_of
from lacuna.llm.common import keyed

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of fewer than 32 fails, and nothing inside it can be longer
#: Weak parts.
IDENT = r"""(?i)(?<![A-Za-z0-9_])(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.+-]{3,}"""
BLOB = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"  # with a digit and a letter
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")


def apart_from(blobs: Column, strong: Column) -> Column:
    """The blobs that overlap no strong part: strong parts by their start, blobs by their end, and the furthest end so far."""
    event = lambda at, kind, x: F.struct(x[at].alias("at"), F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))
    events = F.array_sort(F.concat(F.transform(blobs, lambda x: event("e", 0, x)), F.transform(strong, lambda x: event("s", 1, x))))

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        kept = (x["k"] == 0) & (reach <= x["s"])
        return F.when(x["k"] == 1, F.greatest(reach, x["e"])).otherwise(reach), F.when(kept, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))).otherwise(no_spans())

    return F.when((F.size(blobs) > 0) & (F.size(strong) > 0), let(events, lambda es: scan(es, F.lit(0), step, SPAN)["o"])).otherwise(blobs)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``uid, doc_id, parts``: each text's strong and weak parts, not linked yet. Narrow."""
    df = keyed(docs, id_col, text_col)
    t = F.col("text")
    assigns = t.contains(":") | t.contains("=")
    df = df.select(
        "uid", "doc_id", "text",
        F.filter(spans_of(t, ASSIGN, assigns), lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= 8).alias("assign"),
        F.filter(spans_of(t, ACCESS, t.contains("AKIA")), lambda x: F.length(x["v"]) >= 16).alias("access"),
        spans_of(t, HEX).alias("hex"),
        spans_of(t, IDENT, assigns).alias("ident"),
        spans_of(t, ENDPOINT, t.contains("://")).alias("endpoint"),
    )
    strong = F.concat("assign", "access", "hex")
    named = (F.size("ident") > 0) | (F.size("access") > 0)
    df = df.withColumn("strong", strong).withColumn("blob", F.when(named, spans_of(t, BLOB)).otherwise(no_spans()))
    df = df.withColumn("blob", F.filter("blob", lambda b: b["v"].rlike("[0-9]") & b["v"].rlike("[A-Za-z]")))
    df = df.withColumn("blob", apart_from(F.col("blob"), F.col("strong")))

    def tagged(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].cast("long").alias("s"), F.lit(i).alias("k"), x["e"].cast("long").alias("e"), x["v"].alias("v")))

    parts = [tagged(i, kind) for i, kind in enumerate(KINDS)]
    return df.select("uid", "doc_id", F.concat(*parts).alias("parts"))


def link(parts: DataFrame, radius: int = 256) -> DataFrame:
    """``uid, doc_id, spans``: strong parts, and the weak parts whose scope completes a credential.

    A weak identifier needs a secret in scope, a weak secret an identifier, an endpoint both. ``spans`` is an array of
    ``struct<s, k, e, v>`` in order; ``k`` counts through KINDS.
    """
    one = parts.select("uid", "doc_id", F.explode_outer("parts").alias("p")).select("uid", "doc_id", "p.*")
    # each part twice: where it starts, and where its scope ends; there, the furthest end of the parts begun so far tells
    one = one.withColumn("asks", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("at", F.when(F.col("asks"), F.col("e") + radius).otherwise(F.col("s")))
    scope = Window.partitionBy("uid").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    near = lambda *kinds: F.coalesce(F.max(F.when(~F.col("asks") & F.col("k").isin(*(KINDS.index(x) for x in kinds)), F.col("e"))).over(scope) >= F.col("s") - radius, F.lit(False))
    one = one.withColumns({"id_near": near("access", "ident"), "secret_near": near("assign", "hex", "blob")})
    kept = (F.col("k") <= 2) | ((F.col("k") == 3) & F.col("secret_near")) | ((F.col("k") == 4) & F.col("id_near")) | (F.col("id_near") & F.col("secret_near"))
    return one.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("asks") & kept, F.struct("s", "k", "e", "v")))).alias("spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 256) -> DataFrame:
    """``doc_id, spans``: one row for each input row; spans are ``struct<kind, start, end, value>`` by start, then kind."""
    name = F.array(*map(F.lit, KINDS))
    shaped = lambda x: F.struct(F.element_at(name, x["k"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["v"].alias("value"))
    return link(find_parts(docs, id_col, text_col), radius).select("doc_id", F.transform("spans", shaped).alias("spans"))
