"""Queries over manifests: rules, summaries, leakage, derived manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..operators import duplicates as D
from ..operators import manifest as MF
from ..session import new_path
from ..sources import manifests as S
from .fixtures import H, R
from .registry import query


@query("s1_manifest_scan", "manifest", """SELECT video_id, dataset, split, has_audio, duration_s FROM manifest WHERE split = 'train' AND dataset = 'ffpp' AND has_audio""")
def _(t):
    path = new_path(t.spark, "manifest")
    S.write_manifest(t.manifest, path)
    out = S.read_manifest(t.spark, path, split="train", dataset="ffpp", has_audio=True)
    return out.select("video_id", "dataset", "split", "has_audio", "duration_s")


@query("s2_manifest_sink", "manifest", "SELECT dataset, count(*) AS n, 1 AS version FROM manifest GROUP BY dataset")
def _(t):
    path = new_path(t.spark, "manifest")
    S.write_manifest(t.manifest, path, partition_by=["dataset"])
    df = S.read_manifest(t.spark, path)
    from ..schemas import read_version

    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(read_version(df, "video_id")))


@query("p1_row_validation", "manifest_bad", """SELECT video_id, array_to_string(list_filter([
     CASE WHEN NOT fps > 0 THEN 'fps: not positive' END, CASE WHEN NOT n_frames > 0 THEN 'n_frames: not positive' END,
     CASE WHEN NOT duration_s > 0 THEN 'duration_s: not positive' END,
     CASE WHEN label = 0 AND forgery_method <> 'real' THEN 'label 0 needs method ''real''' END,
     CASE WHEN label = 1 AND forgery_method = 'real' THEN 'label 1 needs a named method' END], lambda x: x IS NOT NULL), '; ') AS errors
   FROM manifest_bad WHERE NOT (fps > 0 AND n_frames > 0 AND duration_s > 0 AND (label = 1) = (forgery_method <> 'real'))""")
def _(t):
    _, bad = MF.validate(t.manifest_bad)
    return bad.select("video_id", F.array_join("errors", "; ").alias("errors"))


@query("p2_duplicate_keys", "manifest_bad", "SELECT video_id, count(*) - 1 AS extra FROM manifest_bad GROUP BY video_id HAVING count(*) > 1")
def _(t):
    return MF.duplicate_keys(t.manifest_bad)


@query("p3_column_check", "manifest", "SELECT dataset, count(*) AS n, 'manifest: missing columns [''fps'', ''sha256'']' AS problem FROM manifest GROUP BY dataset")
def _(t):
    from ..schemas import MANIFEST, SchemaError, require_columns

    try:
        require_columns(t.manifest.drop("fps", "sha256"), MANIFEST.names, "manifest")
        said = ""
    except SchemaError as e:
        said = str(e)
    return t.manifest.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit(said))


@query("a1_manifest_summary", "manifest", """SELECT dataset, split, count(*) AS n, count(*) FILTER (label = 0) AS n_real, count(*) FILTER (label = 1) AS n_fake,
   count(*) FILTER (has_audio) AS n_audio, count(DISTINCT source_identity) AS n_identities FROM manifest GROUP BY 1, 2""")
def _(t):
    return MF.summarise(t.manifest)


@query("a1_method_counts", "manifest", "SELECT forgery_method, count(*) AS n FROM manifest WHERE label = 1 GROUP BY 1")
def _(t):
    return MF.method_counts(t.manifest)


@query("a2_audio_evidence", "manifest", f"""SELECT *, CASE WHEN with_audio = 0 THEN 'info' WHEN pct < 100 THEN 'warn' END AS severity FROM (
   SELECT dataset, count(*) AS n, count(*) FILTER (has_audio) AS with_audio, {R('100.0::DOUBLE * count(*) FILTER (has_audio) / count(*)', 1)} AS pct FROM manifest GROUP BY dataset)""")
def _(t):
    return MF.audio_evidence(t.manifest)


@query("a3_distribution_skew", "manifest", f"""WITH b AS (SELECT dataset, count(*) FILTER (label = 0) AS n_real, count(*) FILTER (label = 1) AS n_fake, count(DISTINCT source_identity) AS n_identities,
     {R('quantile_cont(duration_s, 0.5)', 1)} AS duration_median, {R('quantile_cont(duration_s, 0.05)', 1)} AS duration_p05, {R('quantile_cont(duration_s, 0.95)', 1)} AS duration_p95,
     {R('quantile_cont(fps, 0.5)', 1)} AS fps_median FROM manifest GROUP BY dataset),
   k AS (SELECT dataset, count(*) AS n_methods, max(c) AS most, min(c) AS least FROM (SELECT dataset, forgery_method, count(*) AS c FROM manifest WHERE label = 1 GROUP BY 1, 2) GROUP BY dataset)
   SELECT b.*, {R('n_fake / greatest(n_real, 1)', 2)} AS fake_per_real, coalesce(n_methods, 0) AS n_methods, CASE WHEN n_fake / greatest(n_real, 1) > 3 THEN 'warn' END AS balance_severity,
     CASE WHEN n_methods > 1 AND most / greatest(least, 1) > 2 THEN 'info' END AS method_severity FROM b LEFT JOIN k USING (dataset)""")
def _(t):
    return MF.skew(t.manifest)


@query("a4_missing_splits", "manifest", """SELECT dataset, count(*) AS n, array_to_string(list_sort(list_filter(['train', 'val', 'test'], lambda s: NOT list_contains(list(DISTINCT split), s))), ',') AS missing
   FROM manifest WHERE NOT (dataset = 'dfdc' AND split = 'val') GROUP BY dataset HAVING count(*) > 20 AND count(DISTINCT split) < 3""")
def _(t):
    m = t.manifest.where("NOT (dataset = 'dfdc' AND split = 'val')")
    return MF.missing_splits(m).withColumn("missing", F.array_join("missing", ","))


@query("a5_label_conflicts", "manifest_bad", """SELECT video_id, 'label and method disagree' AS problem FROM manifest_bad WHERE (label = 0 AND forgery_method <> 'real') OR (label = 1 AND forgery_method = 'real') GROUP BY 1
   UNION ALL SELECT video_id, 'conflicting labels' FROM manifest_bad GROUP BY 1 HAVING count(DISTINCT label) > 1""")
def _(t):
    return MF.label_conflicts(t.manifest_bad)


@query("j2_identity_overlap", "manifest", """WITH s AS (SELECT DISTINCT dataset, source_identity, split FROM manifest)
   SELECT a.dataset, a.split || '|' || b.split AS pair, a.source_identity FROM s a JOIN s b ON a.dataset = b.dataset AND a.source_identity = b.source_identity AND a.split < b.split""")
def _(t):
    return MF.identity_overlap(t.manifest)


_DIST = "list_filter(list_transform(range(1, least(len(a.phash), len(b.phash)) + 1), lambda i: bit_count(xor(a.phash[i], b.phash[i]))), lambda d: d <= 6)"
_PAIRS = f"""h AS (SELECT * FROM hashes WHERE len(phash) > 0),
  pr AS (SELECT a.video_id AS video_a, b.video_id AS video_b, {_DIST} AS ds FROM h a JOIN h b ON a.video_id < b.video_id),
  np AS (SELECT video_a, video_b, floor(list_sum(ds) / len(ds))::INT AS distance FROM pr WHERE len(ds) >= 3)"""


@query("j3_near_duplicates", "hashes", f"""WITH c AS (SELECT phash, min(video_id) AS rep, count(*) AS n FROM hashes WHERE len(phash) > 0 GROUP BY phash),
   l AS (SELECT a.rep AS rep_a, b.rep AS rep_b, a.n AS n_a, b.n AS n_b, {_DIST} AS ds FROM c a JOIN c b ON a.rep < b.rep)
   SELECT rep_a, rep_b, n_a, n_b, len(ds)::INT AS n_frames, floor(list_sum(ds) / len(ds))::INT AS distance FROM l WHERE len(ds) >= 3
   UNION ALL SELECT rep, rep, n, n, len(phash)::INT, 0 FROM c WHERE n > 1 AND len(phash) >= 3""")
def _(t):
    return D.near_duplicates(t.hashes)


@query("j3_duplicate_members", "hashes", "SELECT min(video_id) OVER (PARTITION BY phash) AS rep, video_id FROM hashes WHERE len(phash) > 0")
def _(t):
    return D.members(t.hashes)


@query("j4_duplicate_classes", "hashes doc_manifest", f"""WITH {_PAIRS}, c AS (SELECT least(a.dataset || '/' || a.split, b.dataset || '/' || b.split) AS place_a, greatest(a.dataset || '/' || a.split, b.dataset || '/' || b.split) AS place_b,
     CASE WHEN a.dataset = b.dataset THEN 'split' ELSE 'dataset' END AS kind FROM np JOIN doc_manifest a ON a.video_id = video_a JOIN doc_manifest b ON b.video_id = video_b WHERE a.dataset <> b.dataset OR a.split <> b.split)
   SELECT kind, place_a, place_b, count(*) AS n_pairs FROM c GROUP BY ALL""")
def _(t):
    c = D.classify(t.hashes, t.doc_manifest)
    a, b = F.concat_ws("/", "dataset_a", "split_a"), F.concat_ws("/", "dataset_b", "split_b")
    return c.groupBy("kind", F.least(a, b).alias("place_a"), F.greatest(a, b).alias("place_b")).agg(F.sum("n_pairs").alias("n_pairs"))


LISTED = "listed AS (SELECT path FROM manifest WHERE NOT (duration_s < 0.5))"


@query("j5_missing_files", "manifest", f"WITH {LISTED} SELECT path FROM manifest WHERE path NOT IN (SELECT path FROM listed)")
def _(t):
    return MF.missing_files(t.manifest, t.manifest.where("NOT (duration_s < 0.5)").select("path"), None)


def _cache(t):
    m = t.manifest
    return m.select(
        "dataset", "video_id", F.when(F.col("duration_s") < 30, 1).otherwise(0).alias("version"),
        F.when(F.col("duration_s") > 1, 8).otherwise(0).alias("n_faces"),
    )


@query("j6_cache_todo", "manifest", "SELECT dataset, video_id FROM manifest WHERE NOT (duration_s < 30 AND duration_s > 1)")
def _(t):
    return MF.cache_todo(t.manifest, _cache(t), 1).select("dataset", "video_id")


@query("a20_cache_coverage", "manifest", f"""WITH {LISTED} SELECT dataset, count(*) AS n, count(*) FILTER (duration_s < 30 AND duration_s > 1) AS cached, count(*) FILTER (path NOT IN (SELECT path FROM listed)) AS missing_paths,
   count(*) FILTER (duration_s < 30 AND duration_s > 1) / count(*) > 0.95 AS ok FROM manifest GROUP BY dataset""")
def _(t):
    return MF.cache_coverage(t.manifest, _cache(t), 1, t.manifest.where("NOT (duration_s < 0.5)").select("path"))


@query("a6_leak_report", "manifest hashes doc_manifest", f"""WITH {_PAIRS}, {LISTED}, s AS (SELECT DISTINCT dataset, source_identity, split FROM manifest),
   o AS (SELECT count(*) AS identity_overlaps FROM s a JOIN s b ON a.dataset = b.dataset AND a.source_identity = b.source_identity AND a.split < b.split),
   c AS (SELECT count(*) FILTER (a.dataset = b.dataset AND a.split <> b.split) AS split_duplicates, count(*) FILTER (a.dataset <> b.dataset) AS cross_dataset_duplicates
     FROM np JOIN doc_manifest a ON a.video_id = video_a JOIN doc_manifest b ON b.video_id = video_b),
   g AS (SELECT count(*) AS missing_files FROM manifest WHERE path NOT IN (SELECT path FROM listed))
   SELECT identity_overlaps, 0 AS label_conflicts, split_duplicates, cross_dataset_duplicates, missing_files, identity_overlaps + split_duplicates + missing_files = 0 AS ok FROM o, c, g""")
def _(t):
    classes = D.classify(t.hashes, t.doc_manifest)
    return MF.leak_report(t.manifest, classes, t.manifest.where("NOT (duration_s < 0.5)").select("path"))


@query("u1_concat_manifests", "manifest", "SELECT dataset, count(*) AS n FROM manifest WHERE split <> 'val' GROUP BY dataset")
def _(t):
    out = MF.concat_manifests(t.manifest.where("split = 'train'"), t.manifest.where("split = 'test'"))
    return out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("u2_split_intersection", "manifest", """SELECT source_identity FROM manifest WHERE split = 'train' INTERSECT SELECT source_identity FROM manifest WHERE split = 'test'""")
def _(t):
    who = lambda s: t.manifest.where(F.col("split") == s).select("source_identity")
    return who("train").intersect(who("test"))


@query("u3_set_difference", "manifest", """SELECT source_identity FROM manifest WHERE split = 'train' EXCEPT SELECT source_identity FROM manifest WHERE split = 'test'""")
def _(t):
    who = lambda s: t.manifest.where(F.col("split") == s).select("source_identity")
    return who("train").subtract(who("test"))


@query("w6_hash_split", "manifest", f"""SELECT source_identity, CASE WHEN {H("'7:' || source_identity")} < 0.8::DOUBLE THEN 'train' WHEN {H("'7:' || source_identity")} < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split
   FROM (SELECT DISTINCT source_identity FROM manifest)""")
def _(t):
    from ..functions.hashing import hash_split

    return t.manifest.select("source_identity").distinct().withColumn("split", hash_split("source_identity", (0.8, 0.1, 0.1), 7))


@query("w5_part_split", "manifest", """WITH p AS (SELECT *, 'part_' || (substr(source_identity, 2)::BIGINT % 5) AS part FROM manifest), r AS (SELECT *, dense_rank() OVER (ORDER BY part DESC) AS k FROM (SELECT DISTINCT part FROM p))
   SELECT video_id, CASE k WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM p JOIN r USING (part)""")
def _(t):
    part = F.concat(F.lit("part_"), (F.substring("source_identity", 2, 20).cast("bigint") % 5).cast("string"))
    return S.split_by_part(t.manifest.withColumn("part", part)).select("video_id", "split")


_PARTNER = f"""u AS (SELECT video_id, path, {H('video_id')} AS u FROM manifest),
   pt AS (SELECT video_id, coalesce(lead(path) OVER (ORDER BY u, video_id), first_value(path) OVER (ORDER BY u, video_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS partner FROM u)"""


@query("j16_partner_pairing", "manifest", f"WITH {_PARTNER} SELECT video_id, partner FROM pt")
def _(t):
    return MF.partner_paths(t.manifest).select("video_id", "partner")


@query("w8_lead_with_wrap", "manifest", f"WITH {_PARTNER} SELECT count(*) AS n, count(DISTINCT partner) AS n_partners FROM pt")
def _(t):
    return MF.partner_paths(t.manifest).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("partner").alias("n_partners"))


_DEGRADED = f"""SELECT video_id || '__' || recipe AS video_id, 'test' AS split, has_audio AND recipe <> 'audio_strip' AS has_audio,
   CASE WHEN recipe IN ('crf23', 'crf32', 'crf40') THEN recipe ELSE 'unknown' END AS compression FROM manifest, (SELECT unnest({MF.RECIPES}) AS recipe)"""


@query("j15_recipe_variants", "manifest", f"{_DEGRADED} WHERE NOT (recipe = 'hflip' AND duration_s < 5)")
def _(t):
    recipes = MF.RECIPES
    done = t.manifest.withColumn("recipe", F.explode(F.lit(recipes))).where("NOT (recipe = 'hflip' AND duration_s < 5)")
    done = done.withColumn("path", F.concat_ws("/", F.lit("/degraded"), "recipe", "video_id"))
    return MF.degrade_manifest(t.manifest, recipes, done).select("video_id", "split", "has_audio", "compression")


@query("q7_curation_audit", "manifest hashes doc_manifest", f"""WITH {_PAIRS}, dc AS (SELECT CASE WHEN a.dataset = b.dataset THEN 'split' ELSE 'dataset' END AS kind
     FROM np JOIN doc_manifest a ON a.video_id = video_a JOIN doc_manifest b ON b.video_id = video_b WHERE a.dataset <> b.dataset OR a.split <> b.split), s AS (SELECT DISTINCT dataset, source_identity, split FROM manifest), a AS (SELECT dataset, count(*) FILTER (has_audio) AS w, count(*) AS n FROM manifest GROUP BY 1),
   o AS (SELECT a.dataset, a.split || '|' || b.split AS pair, count(*) AS k FROM s a JOIN s b ON a.dataset = b.dataset AND a.source_identity = b.source_identity AND a.split < b.split GROUP BY 1, 2)
   SELECT 'blocker' AS severity, 'identity overlap' AS title, dataset || ':' || pair AS subject, k AS n FROM o
   UNION ALL SELECT CASE WHEN w = 0 THEN 'info' ELSE 'warn' END, 'audio coverage', dataset, w FROM a WHERE w < n
   UNION ALL SELECT CASE kind WHEN 'split' THEN 'blocker' ELSE 'warn' END, 'near duplicates', kind, count(*) FROM dc GROUP BY kind""")
def _(t):
    from .reports import curation_findings

    return curation_findings(t.manifest, D.classify(t.hashes, t.doc_manifest))


@query("q11_degraded_manifest", "manifest", f"SELECT compression, has_audio, count(*) AS n FROM ({_DEGRADED} WHERE NOT (recipe = 'hflip' AND duration_s < 5)) GROUP BY 1, 2")
def _(t):
    # What was rendered is a table of its own; some clips of a recipe failed.
    done = t.manifest.withColumn("recipe", F.explode(F.lit(MF.RECIPES))).where("NOT (recipe = 'hflip' AND duration_s < 5)")
    done = done.withColumn("path", F.concat_ws("/", F.lit("/degraded"), "recipe", "video_id"))
    path = new_path(t.spark, "degraded")
    S.write_manifest(MF.degrade_manifest(t.manifest, MF.RECIPES, done), path)
    return S.read_manifest(t.spark, path).groupBy("compression", "has_audio").agg(F.count(F.lit(1)).alias("n"))
