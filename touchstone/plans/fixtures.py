"""Detector-shaped views over the benchmark tables, in Spark and as SQL.

``Tables`` builds each view lazily from parquet; ``with_views`` gives the same views as
common table expressions, so that a query and its SQL twin read identical rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction, hash_split
from ..functions.numeric import clip, half_up, logit
from ..session import cut

MAX_PRICE = 105000.0


def pick(values, index):
    """``values[index]`` for a small literal list."""
    out = F.lit(values[-1])
    for i in reversed(range(len(values) - 1)):
        out = F.when(index == i, values[i]).otherwise(out)
    return out


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def preds(self) -> DataFrame:
        e, u, k = self.events, F.col("user_id"), F.col("event_id")
        label = F.col("event_type").isin("error", "purchase").cast("int")
        score = half_up(clip(F.lit(0.05) * label + F.lit(0.9) * F.col("value") / F.lit(500.0), 0.0, 1.0), 4)
        return e.select(
            F.concat(F.lit("v"), k.cast("string")).alias("video_id"),
            label.alias("label"),
            pick(["ffpp", "celebdf", "dfdc"], u % 3).alias("dataset"),
            F.when(label == 1, F.col("event_type")).otherwise("real").alias("forgery_method"),
            pick(["c23", "c40", "unknown"], k % 3).alias("compression"),
            F.concat(F.lit("u"), u.cast("string")).alias("source_identity"),
            score.alias("video_score"),
            (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 2 == 0).alias("has_audio"),
            "ts",
            k.alias("event_id"),
            u.alias("user_id"),
        )

    @cached_property
    def preds_split(self) -> DataFrame:
        return self.preds.withColumn("split", hash_split("source_identity"))

    @cached_property
    def preds_logit(self) -> DataFrame:
        return self.preds_split.withColumn("logit", logit("video_score"))

    @cached_property
    def preds_alt(self) -> DataFrame:
        other = F.lit(0.5) * F.col("video_score") + F.lit(0.5) * hash_fraction(F.concat(F.lit("alt:"), "video_id"))
        return self.preds.withColumn("alt_score", half_up(other, 4))

    @cached_property
    def preds_li(self) -> DataFrame:
        label = (F.col("l_returnflag") == "R").cast("int")
        score = F.lit(0.05) * label + F.lit(0.9) * F.col("l_extendedprice") / F.lit(MAX_PRICE)
        return self.raw("lineitem").select(
            label.alias("label"), half_up(clip(score, 0.0, 1.0), 6).alias("score"), F.col("l_linestatus").alias("grp")
        )

    @cached_property
    def manifest(self) -> DataFrame:
        o, cust = F.col("o_orderkey"), F.col("o_custkey")
        vid = F.concat(F.lit("o"), o.cast("string"))
        who = F.concat(F.lit("c"), cust.cast("string"))
        label = (F.col("o_orderstatus") == "F").cast("int")
        dur = half_up(F.col("o_totalprice") / 10000.0, 3)
        return self.raw("orders").select(
            vid.alias("video_id"),
            F.concat(F.lit("/data/"), vid, F.lit(".mp4")).alias("path"),
            label.alias("label"),
            pick(["ffpp", "celebdf", "dfdc"], cust % 3).alias("dataset"),
            F.when(label == 1, F.col("o_orderpriority")).otherwise("real").alias("forgery_method"),
            F.when(o % 50 == 0, "test").otherwise(hash_split(who)).alias("split"),
            (o % 4 != 0).alias("has_audio"),
            who.alias("source_identity"),
            pick(["c23", "c40", "unknown"], o % 3).alias("compression"),
            F.lit(25.0).alias("fps"),
            F.floor(dur * 25).cast("int").alias("n_frames"),
            dur.alias("duration_s"),
            F.sha2(vid, 256).alias("sha256"),
        )

    @cached_property
    def manifest_bad(self) -> DataFrame:
        m = self.manifest.withColumn("_k", F.substring("video_id", 2, 20).cast("bigint"))
        flipped = m.withColumns(
            {
                "label": F.when(F.col("_k") % 97 == 0, 1 - F.col("label")).otherwise(F.col("label")),
                "fps": F.when(F.col("_k") % 101 == 0, 0.0).otherwise(F.col("fps")),
            }
        )
        copies = flipped.where(F.col("_k") % 103 == 0)
        return flipped.unionByName(copies).drop("_k")

    @cached_property
    def hashes(self) -> DataFrame:
        # A byte per 25 characters of the whole text, eight bytes a signature (the last
        # eight where fewer are left): a small edit changes a few bits of one signature.
        pieces = F.regexp_extract_all("text", F.lit("(?s).{1,25}"), F.lit(0))
        docs = self.raw("documents").select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("video_id"),
            F.transform(pieces, lambda x: F.substring(F.sha2(x, 256), 1, 2)).alias("bytes"),
        )
        m = F.size("bytes")
        # Fewer than eight bytes are filled up with zeros.
        ks = F.when(m > 0, F.sequence(F.lit(0), F.ceil(m / 8).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        taken = lambda k: F.slice("bytes", F.greatest(F.least(k * 8, m - 8), F.lit(0)) + 1, 8)
        word = lambda k: F.conv(F.rpad(F.array_join(taken(k), ""), 16, "0"), 16, -10).cast("bigint")
        # Signatures are a stored table; a filter on them would work them out per element.
        return cut(docs.select("video_id", F.transform(ks, word).alias("phash")), "hashes")

    @cached_property
    def doc_manifest(self) -> DataFrame:
        """Dataset and split of each hashed document, for classifying duplicates."""
        d = F.col("doc_id")
        vid = F.concat(F.lit("d"), d.cast("string"))
        return self.raw("documents").select(
            vid.alias("video_id"), "source", F.col("lang").alias("dataset"), hash_split(vid).alias("split")
        )

    @cached_property
    def vec(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec")
        )

    @cached_property
    def win(self) -> DataFrame:
        w = self.vec.select((F.floor(F.col("vec_id") / 10)).alias("clip"), (F.col("vec_id") % 10).alias("w"), F.col("vec").alias("v"))
        nxt = Window.partitionBy("clip").orderBy("w")
        return w.withColumn("a", F.coalesce(F.lead("v").over(nxt), "v"))

    @cached_property
    def frames(self) -> DataFrame:
        us = F.unix_micros("ts")
        first = self.events.groupBy("user_id").agg(F.min(us).alias("first_us"))
        return self.events.join(first, "user_id").select(
            F.col("user_id").alias("clip"),
            "event_id",
            ((us - F.col("first_us")) / 1e6).alias("ts_s"),
            (F.col("value") / 500.0).alias("score"),
            "value",
        )

    @cached_property
    def intervals(self) -> DataFrame:
        span = self.frames.groupBy("clip").agg(F.max("ts_s").alias("last"))
        days = F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 86400).cast("int"), F.lit(3)))
        return span.select("clip", days.alias("d")).select(
            "clip", (F.col("d") * 86400.0).alias("start_s"), (F.col("d") * 86400.0 + 21600.0).alias("end_s")
        )

    @cached_property
    def variants(self) -> DataFrame:
        names = F.explode(F.array(*[F.lit(v) for v in ["orig", "crf32", "crf40", "half_res"]])).alias("variant")
        v = self.preds.select("video_id", "video_score", names)
        key = F.concat(F.col("variant"), F.lit(":"), F.col("video_id"))
        h = hash_fraction(key)
        return v.select(
            "video_id",
            "variant",
            clip(F.col("video_score") + F.lit(0.2) * (h - 0.5), 0.0, 1.0).alias("prob"),
            F.when(h < 0.02, "DecodeError: broken").otherwise("").alias("error"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(
                F.col("l_returnflag").alias("exp"),
                (F.col("l_suppkey") % 3).cast("int").alias("seed"),
                F.year("l_shipdate").cast("string").alias("split"),
            )
            .agg(
                F.count(F.lit(1)).alias("n"),
                (F.avg("l_discount") * 10).alias("auc"),
                (F.avg("l_tax") * 10).alias("accuracy"),
                (F.avg("l_quantity") / 50).alias("f1"),
                (F.avg("l_linenumber") / 10).alias("eer"),
                (F.avg("l_extendedprice") / MAX_PRICE).alias("ece"),
            )
        )

    @cached_property
    def epochs(self) -> DataFrame:
        month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
        by_month = (
            self.raw("orders")
            .groupBy((F.col("o_custkey") % 20).cast("int").alias("run"), month.alias("m"))
            .agg((F.avg("o_totalprice") / 500000.0).alias("val_auc"))
        )
        rank = F.dense_rank().over(Window.partitionBy("run").orderBy("m")) - 1
        return by_month.select("run", rank.alias("epoch"), half_up("val_auc", 6).alias("val_auc"))

    @cached_property
    def changes(self) -> DataFrame:
        day = F.floor(F.unix_micros("ts") / F.lit(86400000000)).cast("bigint")
        state = (
            F.when(F.col("event_type") == "signup", "queued")
            .when(F.col("event_type").isin("view", "click"), "running")
            .when(F.col("event_type") == "purchase", "done")
            .otherwise("failed")
        )
        return self.events.select(
            (F.col("user_id") * 100000 + day).alias("job_id"),
            state.alias("state"),
            F.when(F.col("event_type") == "view", "probe").when(F.col("event_type") == "click", "infer")
            .otherwise(state).alias("stage"),
            F.concat(F.lit("clip"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("filename"),
            F.unix_micros("ts").alias("updated_us"),
            F.col("event_id").alias("seq"),
            "ts",
            "value",
        )

    @cached_property
    def uploads(self) -> DataFrame:
        k = F.col("event_id")
        codecs = ["h264", "hevc", "vp8", "vp9", "av1", "mpeg4", "mjpeg", "theora", "prores", "dnxhd"]
        return self.events.select(
            F.concat(F.lit("up"), k.cast("string")).alias("upload_id"),
            F.col("value").alias("duration_s"),
            (k % 1000 + 64).cast("int").alias("width"),
            (k % 720).cast("int").alias("height"),
            pick(codecs, k % 10).alias("codec"),
            F.floor(F.col("value") * 1e6).cast("bigint").alias("size_bytes"),
            "ts",
            k.alias("seq"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.events.select((F.col("user_id") % 5).alias("client"), "ts", F.col("event_id").alias("seq"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents")

    @cached_property
    def boxes(self) -> DataFrame:
        us = F.unix_micros("ts")
        hour = F.floor(us / F.lit(3600000000)).cast("bigint")
        x = (F.col("value") * 37) % 1000
        y = (F.col("value") * 91) % 700
        side = (F.col("value") * 13) % 160 + 10
        return self.events.select(
            F.col("user_id").alias("clip"),
            hour.alias("frame"),
            F.col("event_id").alias("seq"),
            x.alias("x0"),
            y.alias("y0"),
            (x + side).alias("x1"),
            (y + side * 1.2).alias("y1"),
            ((F.col("event_id") % 100) / 100.0).alias("conf"),
        )


# --------------------------------------------------------------------------
# the same views as SQL
# --------------------------------------------------------------------------
def H(expr: str) -> str:
    return f"(('0x' || substr(sha256({expr}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def R(expr: str, n: int) -> str:
    k = 10**n
    return f"(floor(({expr})::DOUBLE * {k}::DOUBLE + 0.5::DOUBLE) / {k}::DOUBLE)"


def SPLIT(expr: str) -> str:
    u = H(f"'0:' || {expr}")
    return f"(CASE WHEN {u} < 0.7::DOUBLE THEN 'train' WHEN {u} < 0.85::DOUBLE THEN 'val' ELSE 'test' END)"


_FOUR = "(0.05::DOUBLE * lab + 0.9::DOUBLE * value / 500.0::DOUBLE)"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "preds": (
        (),
        f"""SELECT 'v' || event_id AS video_id, lab AS label,
            CASE user_id % 3 WHEN 0 THEN 'ffpp' WHEN 1 THEN 'celebdf' ELSE 'dfdc' END AS dataset,
            CASE WHEN lab = 1 THEN event_type ELSE 'real' END AS forgery_method,
            CASE event_id % 3 WHEN 0 THEN 'c23' WHEN 1 THEN 'c40' ELSE 'unknown' END AS compression,
            'u' || user_id AS source_identity,
            {R(f'least(greatest({_FOUR}, 0.0::DOUBLE), 1.0::DOUBLE)', 4)} AS video_score,
            (regexp_extract(props, '([0-9]+)', 1)::INT % 2 = 0) AS has_audio, ts, event_id, user_id
            FROM (SELECT *, (event_type IN ('error', 'purchase'))::INT AS lab FROM events)""",
    ),
    "preds_split": (("preds",), f"SELECT *, {SPLIT('source_identity')} AS split FROM preds"),
    "preds_logit": (
        ("preds_split",),
        """SELECT *, ln(cp / (1.0::DOUBLE - cp)) AS logit FROM (
            SELECT *, least(greatest(video_score, 0.0001::DOUBLE), 0.9999::DOUBLE) AS cp FROM preds_split)""",
    ),
    "preds_alt": (
        ("preds",),
        f"SELECT *, {R('0.5::DOUBLE * video_score + 0.5::DOUBLE * ' + H(chr(39) + 'alt:' + chr(39) + ' || video_id'), 4)} AS alt_score FROM preds",
    ),
    "preds_li": (
        (),
        f"""SELECT lab AS label, {R(f'least(greatest(0.05::DOUBLE * lab + 0.9::DOUBLE * l_extendedprice / {MAX_PRICE}::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)', 6)} AS score,
            l_linestatus AS grp FROM (SELECT *, (l_returnflag = 'R')::INT AS lab FROM lineitem)""",
    ),
    "manifest": (
        (),
        f"""SELECT video_id, '/data/' || video_id || '.mp4' AS path, label, dataset,
            CASE WHEN label = 1 THEN o_orderpriority ELSE 'real' END AS forgery_method,
            CASE WHEN o_orderkey % 50 = 0 THEN 'test' ELSE {SPLIT('source_identity')} END AS split,
            (o_orderkey % 4 <> 0) AS has_audio, source_identity,
            CASE o_orderkey % 3 WHEN 0 THEN 'c23' WHEN 1 THEN 'c40' ELSE 'unknown' END AS compression,
            25.0::DOUBLE AS fps, floor(duration_s * 25)::INT AS n_frames, duration_s, sha256(video_id) AS sha256
            FROM (SELECT *, 'o' || o_orderkey AS video_id, 'c' || o_custkey AS source_identity,
                  (o_orderstatus = 'F')::INT AS label,
                  CASE o_custkey % 3 WHEN 0 THEN 'ffpp' WHEN 1 THEN 'celebdf' ELSE 'dfdc' END AS dataset,
                  {R('o_totalprice / 10000.0::DOUBLE', 3)} AS duration_s FROM orders)""",
    ),
    "manifest_bad": (
        ("manifest",),
        """SELECT * EXCLUDE (k) FROM (
             SELECT * REPLACE (CASE WHEN k % 97 = 0 THEN 1 - label ELSE label END AS label,
                               CASE WHEN k % 101 = 0 THEN 0.0::DOUBLE ELSE fps END AS fps)
             FROM (SELECT *, substr(video_id, 2)::BIGINT AS k FROM manifest)) t,
             LATERAL (SELECT unnest(CASE WHEN t.k % 103 = 0 THEN [1, 2] ELSE [1] END) AS copy) u""",
    ),
    "hashes": (
        (),
        """SELECT 'd' || doc_id AS video_id,
            list_transform(range(0, (len(bytes) + 7) // 8),
              lambda k: ('0x' || rpad(array_to_string(bytes[greatest(least(k * 8, len(bytes) - 8), 0) + 1 : greatest(least(k * 8, len(bytes) - 8), 0) + 8], ''), 16, '0'))::UBIGINT) AS phash
            FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).{1,25}'), lambda x: substr(sha256(x), 1, 2)) AS bytes FROM documents)""",
    ),
    "doc_manifest": (
        (),
        f"SELECT 'd' || doc_id AS video_id, source, lang AS dataset, {SPLIT(chr(39) + 'd' + chr(39) + ' || doc_id')} AS split FROM documents",
    ),
    "vec": ((), "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings"),
    "win": (
        ("vec",),
        """SELECT vec_id // 10 AS clip, vec_id % 10 AS w, vec AS v,
            coalesce(lead(vec) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id), vec) AS a FROM vec""",
    ),
    "frames": (
        (),
        """SELECT user_id AS clip, event_id,
            (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS ts_s,
            value / 500.0::DOUBLE AS score, value FROM events""",
    ),
    "intervals": (
        ("frames",),
        """SELECT clip, d * 86400.0::DOUBLE AS start_s, d * 86400.0::DOUBLE + 21600.0::DOUBLE AS end_s FROM (
             SELECT clip, unnest(range(0, floor(last / 86400)::BIGINT + 1, 3)) AS d FROM (
               SELECT clip, max(ts_s) AS last FROM frames GROUP BY clip))""",
    ),
    "variants": (
        ("preds",),
        f"""SELECT video_id, variant,
            least(greatest(video_score + 0.2::DOUBLE * (h - 0.5::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS prob,
            CASE WHEN h < 0.02::DOUBLE THEN 'DecodeError: broken' ELSE '' END AS error
            FROM (SELECT video_id, video_score, variant, {H("variant || ':' || video_id")} AS h FROM (
              SELECT video_id, video_score, unnest(['orig', 'crf32', 'crf40', 'half_res']) AS variant FROM preds))""",
    ),
    "runs": (
        (),
        f"""SELECT l_returnflag AS exp, (l_suppkey % 3)::INT AS seed, year(l_shipdate)::VARCHAR AS split, count(*) AS n,
            avg(l_discount) * 10 AS auc, avg(l_tax) * 10 AS accuracy, avg(l_quantity) / 50 AS f1,
            avg(l_linenumber) / 10 AS eer, avg(l_extendedprice) / {MAX_PRICE}::DOUBLE AS ece
            FROM lineitem GROUP BY ALL""",
    ),
    "epochs": (
        (),
        f"""SELECT run, dense_rank() OVER (PARTITION BY run ORDER BY m) - 1 AS epoch, {R('v', 6)} AS val_auc FROM (
            SELECT (o_custkey % 20)::INT AS run, year(o_orderdate) * 12 + month(o_orderdate) AS m,
              avg(o_totalprice) / 500000.0::DOUBLE AS v FROM orders GROUP BY 1, 2)""",
    ),
    "changes": (
        (),
        """SELECT user_id * 100000 + epoch_us(ts) // 86400000000 AS job_id, state,
            CASE event_type WHEN 'view' THEN 'probe' WHEN 'click' THEN 'infer' ELSE state END AS stage,
            'clip' || event_id || '.mp4' AS filename, epoch_us(ts) AS updated_us, event_id AS seq, ts, value FROM (
            SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
              WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state FROM events)""",
    ),
    "uploads": (
        (),
        """SELECT 'up' || event_id AS upload_id, value AS duration_s, (event_id % 1000 + 64)::INT AS width,
            (event_id % 720)::INT AS height,
            ['h264', 'hevc', 'vp8', 'vp9', 'av1', 'mpeg4', 'mjpeg', 'theora', 'prores', 'dnxhd'][event_id % 10 + 1] AS codec,
            floor(value * 1000000.0::DOUBLE)::BIGINT AS size_bytes, ts, event_id AS seq FROM events""",
    ),
    "requests": ((), "SELECT user_id % 5 AS client, ts, event_id AS seq FROM events"),
    "boxes": (
        (),
        """SELECT user_id AS clip, epoch_us(ts) // 3600000000 AS frame, event_id AS seq, x AS x0, y AS y0,
            x + side AS x1, y + side * 1.2::DOUBLE AS y1, (event_id % 100) / 100.0::DOUBLE AS conf FROM (
            SELECT *, (value * 37) % 1000 AS x, (value * 91) % 700 AS y, (value * 13) % 160 + 10 AS side FROM events)""",
    ),
}


def with_views(uses: str, body: str) -> str:
    """``body`` behind the common table expressions it names, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in uses.split():
        add(name)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order]
    body = body.strip()
    if not ctes:
        return body
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return f"{word}{', '.join(ctes)}, {body[len(word):]}"
    return f"WITH {', '.join(ctes)} {body}"
