"""WARC revisit records of the not-modified profile: an as-of join to the latest earlier full response of the same canonical URL.

Captures are (record_id, url, ts, kind, headers, payload_digest, payload_length), kind ``response`` or ``revisit``. A revisit is
matched with the last response of its canonical URL at an earlier time; its validators (ETag compared weakly, else
Last-Modified) must agree with the response's; then it takes over the response's payload, and its own headers replace those of
the response except the ones that describe the payload or the connection.

A URL may hold any share of all captures: time is cut into ``CELLS`` ranges at approximate quantiles, the last response of each
(URL, range) is carried forward over the few ranges of a URL, and only captures of one (URL, range) are ordered in one task.

Of responses with equal times the one of the greatest record_id counts. A capture without a time or URL cannot be
matched: its revisit is ``unmatched``. Repeated revisits are resolved alike. Empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playbill.llm.common import written

CELLS = 512
#: Header fields that a not-modified response must not change: they describe the stored payload, or one connection.
KEPT_HEADERS = (
    "content-length", "content-encoding", "content-type", "content-range", "content-md5", "transfer-encoding", "connection",
    "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "upgrade")
TRACKING = "^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.``, ``m.`` and default ports, no scheme, fragment, tracking parameters or closing slash; query parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)^https?://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^(?:www|m)\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    sorted_query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING)))), "&")
    return F.concat(host, path, F.when(sorted_query == "", "").otherwise(F.concat(F.lit("?"), sorted_query)))


def header(headers: Column, name: str) -> Column:
    """A header field by lower-case name; the last one counts."""
    return F.element_at(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), -1)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def validators_agree(revisit: Column, response: Column) -> Column:
    tag, stored = _weak(header(revisit, "etag")), _weak(header(response, "etag"))
    date, stored_date = header(revisit, "last-modified"), header(response, "last-modified")
    return F.when(tag.isNotNull() & stored.isNotNull(), tag == stored).when(date.isNotNull() & stored_date.isNotNull(), date == stored_date).otherwise(F.lit(False))


def merged_headers(revisit: Column, response: Column) -> Column:
    """The response's fields by lower-case name, overlaid by the revisit's permitted ones."""
    def low(h: Column) -> Column:
        names = F.transform(F.map_entries(h), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        last = F.filter(names, lambda e, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda later: later["key"] == e["key"]))
        return F.map_from_entries(last)

    new = F.map_filter(low(revisit), lambda k, _: ~k.isin(*KEPT_HEADERS))
    old = F.map_filter(low(response), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(old, new)


def latest_earlier(captures: DataFrame, cells: int = CELLS) -> DataFrame:
    """Captures (canonical, ts, kind, full ...) with ``match``, the ``full`` struct of the last response before each, or null."""
    ts = F.unix_micros("ts") if dict(captures.dtypes)["ts"].startswith("timestamp") else F.col("ts")
    rows = captures.withColumn("_at", ts.cast("double"))
    cuts = rows.agg(F.percentile_approx("_at", [i / cells for i in range(1, cells)], 10 * cells)).first()[0] or []
    edges = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>")
    # The range of a time: how many edges lie at or below it, found on at most CELLS - 1 edges.
    rows = rows.withColumn("_cell", F.size(F.filter(edges, lambda e: e <= F.coalesce("_at", F.lit(0.0)))))
    order = F.when((F.col("kind") == "response") & F.col("_at").isNotNull(), F.struct("_at", "record_id"))
    last = rows.groupBy("canonical", "_cell").agg(F.max_by("full", order).alias("_last"))
    earlier = Window.partitionBy("canonical").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("canonical").alias("_url"), F.col("_cell").alias("_range"), F.last("_last", True).over(earlier).alias("_carried"))
    # Times are numbered, so that what is earlier by any fraction is one number lower at least.
    rows = rows.withColumn("_turn", F.dense_rank().over(Window.partitionBy("canonical", "_cell").orderBy("_at")))
    inside = Window.partitionBy("canonical", "_cell").orderBy("_turn").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_inside", F.max_by("full", order).over(inside))
    joined = found.join(carried, F.expr("canonical = _url AND _cell = _range"), "left")
    return joined.withColumn("match", F.when(F.col("_at").isNotNull() & F.col("canonical").isNotNull(), F.coalesce("_inside", "_carried"))).drop(
        "_at", "_cell", "_turn", "_inside", "_url", "_range", "_carried")


def resolved(captures: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row for each revisit: ``status`` (resolved, validator_mismatch, unmatched), ``refers_to`` (record_id of the response),
    ``payload_digest``, ``payload_length`` and ``headers`` of the record it stands for (its own headers if it is not resolved)."""
    full = F.struct("record_id", "payload_digest", "payload_length", "headers", "ts")
    rows = captures.withColumn("canonical", canonical_url(F.col("url"))).withColumn("full", full)
    rows = latest_earlier(rows.select("record_id", "canonical", "ts", "kind", "headers", "full"), cells).where(F.col("kind") == "revisit")
    agrees = F.coalesce(validators_agree(F.col("headers"), F.col("match.headers")), F.lit(False))
    status = F.when(F.col("match").isNull(), "unmatched").when(agrees, "resolved").otherwise("validator_mismatch")
    took = F.col("status") == "resolved"
    return rows.withColumn("status", status).select(
        "record_id", "canonical", "ts", "status", F.col("match.record_id").alias("refers_to"),
        F.when(took, F.col("match.payload_digest")).alias("payload_digest"), F.when(took, F.col("match.payload_length")).alias("payload_length"),
        F.when(took, merged_headers(F.col("headers"), F.col("match.headers"))).otherwise(F.col("headers")).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Two captures for each page: its full response at page_id, and half a step after the next a not-modified revisit by
    another spelling of the URL, of whose validators one in seven is outdated."""
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    etag = lambda d: F.concat(F.lit('"'), F.left(d, F.lit(16)), F.lit('"'))
    day = lambda n: F.concat(F.lit("day "), n.cast("string"))
    id_ = F.col("page_id").cast("long")
    rows = pages.select(id_.alias("page_id"), "url", digest.alias("d"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n"))
    response = rows.select(
        (id_ * 2).alias("record_id"), "url", (id_ * 2).alias("ts"), F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), etag(F.col("d")), F.lit("Date"), day(id_), F.lit("Content-Length"), F.col("n").cast("string"), F.lit("Server"), F.lit("origin")).alias("headers"),
        F.col("d").alias("payload_digest"), F.col("n").alias("payload_length"))
    sent = F.when(id_ % 7 == 0, F.lit('"outdated"')).otherwise(F.concat(F.lit("W/"), etag(F.col("d"))))
    revisit = rows.select(
        (id_ * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#seen")).alias("url"), (id_ * 2 + 3).alias("ts"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("etag"), sent, F.lit("Date"), day(id_ + 1), F.lit("Content-Length"), F.lit("0")).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("long").alias("payload_length"))
    return response.unionByName(revisit)


def digest(pages: DataFrame) -> DataFrame:
    rows = resolved(written(captures_of(pages), "captures"))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))), "\n")
    return rows.select(
        ((F.col("record_id") - 1) / 2).cast("long").alias("page_id"), F.col("canonical").alias("canonical_url"), "status",
        (F.col("refers_to") / 2).cast("long").alias("refers_to_page"), "payload_digest", "payload_length", F.sha2(listed, 256).alias("headers_sha256"))
