"""Validators: keys of cited addresses, corpora of cited claims, bundles of evidence files."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that need no escape, parameters that only track, signs kept in parameters, and the notes.
UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
TRACKING_NAMES = frozenset(("gclid", "fbclid", "msclkid"))
KEPT_IN_NAME, KEPT_IN_VALUE = "!$'()*+,;=:/?@%", "!$'()*+,;=:@%"
NOTES = ("fragment removed; named tracking keys dropped", "fragment removed; tracking-only query dropped", "malformed or unsupported URL; no inference")
DEFAULT_PORTS = {"http": 80, "https": 443}


def _escapes(text: str) -> str:
    """Escapes in capitals, those of unreserved characters undone."""
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)) if chr(int(m[1], 16)) in UNRESERVED else m[0].upper(), text)


def _segments(path: str) -> str:
    """A path without . and .. parts; one that ends in a slash or such a part ends in a slash."""
    kept: list[str] = []
    for part in path.split("/"):
        if part == ".." and kept and kept[-1] not in ("", ".."):
            kept.pop()
        elif part not in (".", ".."):
            kept.append(part)
    out = "/".join(kept)
    ends = path.endswith(("/", "/.", "/.."))
    return (out if not ends or out.endswith("/") else out + "/") or ("/" if path.startswith("/") else "")


def citation_key(raw: str | None, base: str | None = None) -> tuple[str, str, str]:
    """The key of a cited address, how it was got ('normalized', 'relative-resolved' or 'rejected'), and a note.

    Scheme and host in lower case, no default port, no dot parts, no fragment, no tracking parameters, escapes in one form.
    Two addresses of one key are written alike; nothing else is inferred. A path that ends in a slash keeps it once.
    """
    rejected = ("", "rejected", NOTES[2])
    if raw is None or re.search("%(?![0-9A-Fa-f]{2})", raw):
        return rejected
    try:
        u = urlsplit(urljoin(base, raw) if base else raw)
        port, host, scheme = u.port, (u.hostname or "").lower(), u.scheme.lower()
    except ValueError:
        return rejected
    if scheme not in DEFAULT_PORTS or not host:
        return rejected
    where = f"[{host}]" if ":" in host else host
    if u.username is not None:
        where = f"{u.username}{'' if u.password is None else ':' + u.password}@{where}"
    if port is not None and port != DEFAULT_PORTS[scheme]:
        where += f":{port}"
    pairs = [(_escapes(k), _escapes(v)) for k, v in parse_qsl(u.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in TRACKING_NAMES)]
    query = "&".join(quote(k, safe=KEPT_IN_NAME) + (f"={quote(v, safe=KEPT_IN_VALUE)}" if v else "") for k, v in pairs)
    key = urlunsplit((scheme, where, _escapes(_segments(u.path or "/")), query, ""))
    return key, "relative-resolved" if base and not urlsplit(raw).scheme else "normalized", NOTES[1] if u.query and not pairs else NOTES[0]


def citation_keys(df: DataFrame, url: str, base: str | None = None, review: str | None = None) -> DataFrame:
    """The columns of df and normalized_key, status, decision (reject; review where the column review says so; else compare), notes. Each distinct address is read once a batch."""
    @F.pandas_udf("normalized_key string, status string, notes string")
    def run(raw: pd.Series, against: pd.Series) -> pd.DataFrame:
        got = {p: citation_key(*p) for p in set(zip(raw, against, strict=True))}
        return pd.DataFrame([got[p] for p in zip(raw, against, strict=True)], columns=["normalized_key", "status", "notes"])

    k = run(F.col(url), F.coalesce(F.col(base), F.lit("")) if base else F.lit(""))
    decided = F.when(F.col("__k.status") == "rejected", "reject").when((F.col(review) == "review") if review else F.lit(False), "review").otherwise("compare")
    return df.withColumn("__k", k).select("*", "__k.normalized_key", "__k.status", decided.alias("decision"), "__k.notes").drop("__k")


# Labels of support, and kinds of markers that aren't seen.
SUPPORT = ("supported", "contradicted", "insufficient")
UNSEEN = ("none", "malformed_numeric")


def corpus_errors(cases: DataFrame, expected: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """code, case_id, claim_id of what is wrong with a corpus of cited claims; no rows if nothing is.

    cases: case_id, category, ambiguity, claims (claim_id, marker_detected, marker_kind, source_ids, claim_support_label),
    sources (source_id). expected: case_id, claim_id and the labels as text, source_count, ambiguity.
    """
    row = lambda code, df, case="case_id", claim=None: df.select(F.lit(code).alias("code"), F.col(case).cast("string").alias("case_id"), (F.col(claim) if claim else F.lit(None)).cast("string").alias("claim_id"))
    ids = cases.groupBy("case_id").agg(F.count("*").alias("n"))
    claims = cases.select("case_id", "ambiguity", F.col("sources.source_id").alias("known"), F.explode("claims").alias("c"))
    flat = claims.select("case_id", "ambiguity", "known", "c.claim_id", "c.marker_detected", "c.marker_kind", "c.source_ids", "c.claim_support_label")
    e = expected.select("case_id", "claim_id", *(F.lower(F.col(c).cast("string")).alias(f"e_{c}") for c in ("marker_detected", "marker_kind", "claim_support_label", "source_count", "ambiguity")))
    j = flat.join(e, ["case_id", "claim_id"])
    low = lambda c: F.lower(F.col(c).cast("string"))
    wrong = ~(low("marker_detected").eqNullSafe(F.col("e_marker_detected")) & low("marker_kind").eqNullSafe(F.col("e_marker_kind")) & low("claim_support_label").eqNullSafe(F.col("e_claim_support_label")))
    meta = ~(F.size("source_ids").cast("string").eqNullSafe(F.col("e_source_count")) & low("ambiguity").eqNullSafe(F.col("e_ambiguity")))
    here = cases.select(F.col("category").alias("case_id")).distinct()
    need = cases.sparkSession.createDataFrame([(c,) for c in categories], "case_id string")
    parts = [
        row("case_id", ids.where("case_id is null or case_id = '' or n > 1")), row("missing_category", need.join(here, "case_id", "left_anti")), row("duplicate_expected", expected.groupBy("case_id", "claim_id").agg(F.count("*").alias("n")).where("n > 1"), claim="claim_id"),
        row("unexpected_claim", flat.join(expected, ["case_id", "claim_id"], "left_anti"), claim="claim_id"), row("absent_claim", expected.join(flat, ["case_id", "claim_id"], "left_anti"), claim="claim_id"),
        row("no_claims", cases.where("coalesce(size(claims), 0) < 1 or sources is null")), row("unresolved_source", flat.where(F.size(F.array_except("source_ids", "known")) > 0), claim="claim_id"), row("label_mismatch", j.where(wrong), claim="claim_id"), row("metadata_mismatch", j.where(meta), claim="claim_id"),
        row("support_label", flat.where(~F.col("claim_support_label").isin(*SUPPORT)), claim="claim_id"), row("undetected_kind", flat.where(~F.col("marker_detected") & ~F.col("marker_kind").isin(*UNSEEN)), claim="claim_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corpus_table(cases: DataFrame) -> DataFrame:
    """case_id, claim_id, category, marker_detected, marker_kind, claim_support_label, source_count, ambiguity of each claim."""
    return cases.select("case_id", "category", "ambiguity", F.explode("claims").alias("c")).select("case_id", "c.claim_id", "category", "c.marker_detected", "c.marker_kind", "c.claim_support_label", F.size("c.source_ids").alias("source_count"), "ambiguity")


MANIFEST = "manifest_version string, files array<struct<path:string,bytes:bigint,sha256:string>>, references array<struct<source:string,field:string,target:string,id_field:string>>"
SAFE = r"^(?!/)(?!.*(?:^|/)\.\.?/)[A-Za-z0-9._/-]+$"


def bundle_issues(spark: SparkSession, folder: str) -> DataFrame:
    """code, detail of what is wrong with a folder of evidence files and its manifest.json; no rows if nothing is.

    Files are read as they are, hashed where they lie and compared with the manifest; ids that one CSV file refers to and
    another lacks come from anti joins, one for each reference of the manifest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = files.select(F.regexp_extract("path", r"^(.*?)/manifest\.json$", 1).alias("b")).where("b <> ''").first()
    issue = lambda df, code, detail: df.select(F.lit(code).alias("code"), detail.alias("detail"))
    one = spark.range(1)
    if base is None:
        return issue(one, "manifest_missing", F.lit("manifest.json is missing"))
    here = files.select(F.expr(f"substring(path, {len(base['b']) + 2})").alias("path"), "length", F.sha2("content", 256).alias("hash"))
    raw = spark.read.option("wholetext", True).text(f"{folder}/manifest.json").select(F.from_json("value", MANIFEST + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m")).first()["m"]
    if raw is None or raw["_bad"] is not None:
        return issue(one, "manifest_invalid_json", F.lit("manifest.json can't be read"))
    out = [] if raw["manifest_version"] == "1.0" else [issue(one, "manifest_version", F.lit("expected 1.0"))]
    if raw["files"] is None:
        out.append(issue(one, "files_invalid", F.lit("files must be an array")))
    listed = spark.createDataFrame([(f["path"], f["bytes"], f["sha256"]) for f in raw["files"] or [] if f], "path string, bytes long, sha256 string")
    safe = F.col("path").isNotNull() & F.col("path").rlike(SAFE) & (F.col("path") != "manifest.json")
    ok = listed.where(safe)
    j = ok.join(here, "path")
    out += [
        issue(listed.where(~F.coalesce(safe, F.lit(False))), "unsafe_path", F.coalesce("path", F.lit("None"))), issue(ok.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_path", F.col("path")), issue(ok.join(here, "path", "left_anti"), "file_missing", F.col("path")),
        issue(j.where(~F.col("bytes").eqNullSafe(F.col("length"))), "byte_size", F.concat(F.col("path"), F.lit(": expected "), F.coalesce(F.col("bytes").cast("string"), F.lit("None")), F.lit(", got "), F.col("length").cast("string"))),
        issue(j.where(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))), "hash_format", F.col("path")), issue(j.where(F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("sha256") != F.col("hash"))), "sha256", F.concat(F.col("path"), F.lit(": expected "), F.col("sha256"), F.lit(", got "), F.col("hash"))),
    ]
    paths = {f["path"] for f in raw["files"] or [] if f and f["path"] and re.match(SAFE, f["path"])}
    for ref in raw["references"] or []:
        if ref is None or ref["source"] not in paths or ref["target"] not in paths:
            out.append(issue(one, "reference_path", F.lit("reference files must be safe paths listed in files")))
            continue
        a, b = (spark.read.option("header", True).csv(f"{folder}/{ref[k]}") for k in ("source", "target"))
        if ref["field"] not in a.columns or ref["id_field"] not in b.columns:
            continue
        ids = a.select(F.col(ref["field"]).alias("v")).where("v <> ''").distinct().join(b.select(F.col(ref["id_field"]).alias("v")), "v", "left_anti")
        out.append(issue(ids, "internal_id_missing", F.concat(F.lit(f"{ref['source']}:{ref['field']}="), F.col("v"), F.lit(f" not in {ref['target']}:{ref['id_field']}"))))
    result = out[0]
    for p in out[1:]:
        result = result.unionByName(p)
    return result
