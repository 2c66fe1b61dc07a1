"""Plans that write and read files, run streams, or change images made of the given vectors."""

from __future__ import annotations

import math
import struct
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitforge.functions import columns as C
from splitforge.operators import corrupt, images, joins, metrics, verify
from splitforge.plans import base as B
from splitforge.plans.base import scratch
from splitforge.sources import listing, publish, readers, writers
from splitforge.streaming import streams

PLANS: dict = {}


def plan(sql: str | None = None):
    def put(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return put


#: Sub-folders that text files are dealt into.
_FOLDERS = 16


def _text_files(spark, docs: DataFrame) -> str:
    """The folder below which each document stands as a file of its own, named by its id, written by tasks."""
    root = scratch(spark, "texts")
    name = F.concat(F.format_string("%02d/", F.col("doc_id") % _FOLDERS), F.col("doc_id"), F.when(F.col("lang") == "en", ".TXT").otherwise(".txt"))
    listing.write_files(docs, root, name, F.col("text")).write.format("noop").mode("overwrite").save()
    return root


@plan(f"""SELECT format('{{:02d}}', doc_id % {_FOLDERS}) AS prefix, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, min(doc_id || CASE WHEN lang = 'en' THEN '.TXT' ELSE '.txt' END) AS first_name
  FROM documents GROUP BY ALL""")
def src1_file_scan(spark, sf_dir):
    """Every document is written as a file; the folder is listed by its sub-folders, in tasks."""
    root = _text_files(spark, B.table(spark, sf_dir, "documents"))
    return listing.listed(spark, root, ("txt",)).groupBy("prefix").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("name").alias("first_name"))


@plan("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j9_missing_files(spark, sf_dir):
    """The labelled documents are written as files; those of all documents that a listing doesn't have."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    root = _text_files(spark, docs.join(B.table(spark, sf_dir, "labels"), "doc_id", "left_semi"))
    # The sub-folders are known here, so the driver looks at no folder.
    found = listing.listed(spark, root, ("txt",), prefixes=[f"{k:02d}" for k in range(_FOLDERS)])
    return joins.missing_files(docs.select("doc_id"), found.select(F.substring_index("name", ".", 1).cast("long").alias("doc_id")), "doc_id")


@plan("SELECT CAST(doc_id AS VARCHAR) AS image_path, CAST(quality AS INT) AS label FROM labels")
def src4_strict_manifest(spark, sf_dir):
    path = scratch(spark, "manifest")
    rows = B.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("image_path"), F.col("quality").cast("int").alias("label"))
    writers.manifest(rows, path, ["image_path", "label"])
    return readers.strict_manifest(spark, path)


@plan("SELECT CAST(quality AS INT) AS label, count(*) AS n FROM labels WHERE quality IN (0, 1) GROUP BY ALL")
def src2_labelled_folders(spark, sf_dir):
    """The labelled ids are written as text files into folders whose names stand for the label, and one that has no known
    name; the files found there are read with their label."""
    root = scratch(spark, "folders")
    rows = B.table(spark, sf_dir, "labels").select("quality", F.col("doc_id").cast("string").alias("value"))
    for folder, chosen in (("REAL", "quality = 0"), ("1_fake", "quality = 1"), ("other", "quality IS NOT NULL")):
        rows.where(chosen).select("value").write.text(f"{root}/train/{folder}")
    found = readers.labelled_folders(spark, root, extensions=("txt",))
    lines = spark.read.option("recursiveFileLookup", True).text(root).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"))
    return lines.join(found.withColumn("path", F.regexp_replace("path", "^file:/+", "/")), "path").groupBy("label").agg(F.count("*").alias("n"))


@plan(f"WITH {B.VECTORS}, {B.SCORED}, m AS ({B.metrics_sql('scored', 'model, name, param')}) SELECT model, name, param, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1 FROM m")
def src7_metric_json(spark, sf_dir):
    """The JSON half of a metric table, with all places."""
    path, keys = scratch(spark, "metrics"), ["model", "name", "param"]
    writers.metrics(metrics.classification(B.scored(spark, sf_dir), keys), path, [*keys, "accuracy", "f1"])
    rows = readers.metric_json(spark, f"{path}.json", "model string, name string, param string, accuracy double, f1 double")
    return rows.select(*keys, F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"))


@plan("SELECT source, count(*) AS n, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def snk1_wide_manifest(spark, sf_dir):
    """A manifest written as Parquet, written again when forced, and read back."""
    path = scratch(spark, "manifest")
    rows = B.texts(spark, sf_dir).select(F.col("sample_id").alias("image_path"), "label", "source")
    for force in (False, True):
        writers.manifest(rows, path, ["image_path", "label", "source"], force=force, kind="parquet")
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.count("label").alias("labelled"))


@plan("SELECT 'exists' AS refused, count(*) AS kept FROM labels UNION ALL SELECT 'protected', count(*) FROM labels")
def snk2_write_once(spark, sf_dir):
    """What a second write that isn't forced, and a forced one below a protected folder, leave of a manifest: all of it."""
    path = scratch(spark, "manifest")
    rows = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    writers.manifest(rows, path, ["doc_id", "quality"], kind="parquet")
    refused = []
    for name, options in (("exists", {}), ("protected", {"force": True, "protected": [path.rsplit("/", 1)[0]]})):
        try:
            writers.manifest(rows.where("quality = 1"), path, ["doc_id", "quality"], kind="parquet", **options)
        except (FileExistsError, PermissionError):
            refused.append(name)
    return spark.read.parquet(path).agg(F.count("*").alias("kept")).crossJoin(B.names(spark, "refused", refused)).select("refused", "kept")


@plan("SELECT count(*) AS n, 1 AS writers_seen, true AS one_refused FROM labels")
def snk1_two_writers(spark, sf_dir):
    """Two writers of one manifest at the same time, each with all labelled ids under a label of its own: one of them is
    refused and the rows are those of the other alone."""
    path = scratch(spark, "manifest")
    rows = B.table(spark, sf_dir, "labels")

    def put(writer: int) -> bool:
        try:
            writers.manifest(rows.withColumn("writer", F.lit(writer)), path, ["doc_id", "writer"], kind="parquet")
        except FileExistsError:
            return False
        return True

    with ThreadPoolExecutor(2) as pool:
        written = list(pool.map(put, (1, 2)))
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("writer").alias("writers_seen"), F.lit(sum(written) == 1).alias("one_refused"))


@plan(f"WITH {B.VECTORS}, {B.SCORED} SELECT CAST(sample_id AS VARCHAR) AS image_path, CAST(pred AS BIGINT) AS pred FROM scored WHERE model = 'robust' AND name = 'clean'")
def snk3_predictions(spark, sf_dir):
    path = scratch(spark, "predictions")
    writers.predictions(B.scored(spark, sf_dir).where("model = 'robust' AND name = 'clean'"), path)
    return spark.read.json(path, schema="image_path string, pred long")


@plan(f"WITH {B.VECTORS}, {B.SCORED}, m AS ({B.metrics_sql('scored', 'model, name, param')}) SELECT model, name, param, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM m")
def snk4_metric_table(spark, sf_dir):
    path = scratch(spark, "metrics")
    keys = ["model", "name", "param"]
    writers.metrics(metrics.classification(B.scored(spark, sf_dir), keys), path, [*keys, "accuracy", "f1"])
    return readers.metric_table(spark, f"{path}.csv", keys)


@plan("SELECT l_linenumber AS epoch, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def snk5_append_log(spark, sf_dir):
    """A stream of the line items adds its counts to a log batch by batch; all batches are delivered once more, as after
    a driver that died before it noted them, and each is in the log once."""
    path, source = scratch(spark, "log"), scratch(spark, "lines")
    B.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("epoch")).repartition(4).write.parquet(source)

    def put(df: DataFrame, batch: int) -> None:
        publish.appended(df.groupBy("epoch").agg(F.count("*").alias("n")), path, batch)

    for _ in range(2):
        lines = spark.readStream.schema("epoch int").option("maxFilesPerTrigger", 2).parquet(source)
        lines.writeStream.foreachBatch(put).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return publish.log(spark, path, "epoch int, n long").groupBy("epoch").agg(F.sum("n").alias("n"))


def _folder_digests(spark, path: str) -> DataFrame:
    """(path, digest) of each partition folder, from the digests of its files."""
    rows = readers.snapshot(spark, path).where(F.col("path").endswith(".parquet"))
    one = F.conv(F.substring("digest", 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(F.regexp_extract("path", "/(source=[^/]*)/[^/]*$", 1).alias("path")).agg(F.concat_ws("-", F.count("*"), F.sum(one)).alias("digest"))


@plan("SELECT CASE WHEN source = 'src1' THEN 'altered' WHEN source = 'src2' THEN 'added' END AS change, count(DISTINCT source) AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY ALL")
def v6_frozen_artefacts(spark, sf_dir):
    """The documents are written by source, all but src2, and the digests of their files are taken; src1 is written again
    with other texts and src2 is added; the changes are found."""
    path = scratch(spark, "frozen")
    rows = B.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows.where("source != 'src2'").write.partitionBy("source").parquet(path)
    before = B.stored(_folder_digests(spark, path), "digests")
    later = rows.where("source = 'src1'").withColumn("text", F.upper("text")).unionByName(rows.where("source = 'src2'"))
    later.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    return verify.frozen_changes(before, _folder_digests(spark, path)).groupBy("change").agg(F.count("*").alias("n"))


def _events(spark, sf_dir, files: int | None = None) -> DataFrame:
    """All events twice, as a stream; or once, from so many files that arrive one by one."""
    rows = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("record"))
    path = scratch(spark, "events")
    (rows if files is None else rows.repartition(files, "record")).write.parquet(path)
    if files is None:
        rows.write.mode("append").parquet(path)
        return spark.readStream.schema(rows.schema).parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _ended(spark, df: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    df.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@plan("SELECT event_type AS key, least(2 * count(*), CASE event_type WHEN 'click' THEN 40 ELSE 15 END) AS n FROM events GROUP BY event_type")
def st1_stateful_quota(spark, sf_dir):
    """Every event comes twice; the stream lets pass 40 clicks and 15 of each other type."""
    caps = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("key")).distinct().withColumn("cap", F.when(F.col("key") == "click", 40).otherwise(15))
    with B.rocksdb(spark):
        kept = _ended(spark, streams.stream_quota(_events(spark, sf_dir), caps), "quota")
    return kept.groupBy("key").agg(F.count("*").alias("n"))


#: Files that events arrive in one after another.
_ARRIVALS = 12


@plan("""SELECT event_type AS key, CAST(count(*) // CASE WHEN event_type = 'click' THEN 8 ELSE 4 END AS BIGINT) AS cap, CAST(count(*) // CASE WHEN event_type = 'click' THEN 8 ELSE 4 END AS BIGINT) AS taken, CAST(0 AS BIGINT) AS missing, true AS files_left
  FROM events GROUP BY event_type""")
def st1_until_full(spark, sf_dir):
    """An eighth of the clicks, which are held out, and a quarter of every other type are collected from a stream that has no
    end of its own; it ends when all quotas are full, with files that were never read."""
    counts = B.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    caps = streams.caps_by_kind(counts, B.names(spark, "key", ["click"]), F.floor(F.col("n") / 4), F.floor(F.col("n") / 8))
    path = scratch(spark, "collected")
    with B.rocksdb(spark):
        ended = streams.collect_until_full(_events(spark, sf_dir, _ARRIVALS), caps, path, f"{path}-state", timeout=600)
    report = streams.shortfall(caps, spark.read.parquet(path).select("key"))
    return report.withColumn("files_left", F.lit(ended.full and ended.batches < _ARRIVALS))


@plan("SELECT count(DISTINCT sha256(text)) AS kept, count(DISTINCT sha256(text)) AS state_rows, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text)")
def st2_stream_dedup(spark, sf_dir):
    """The documents arrive in three deliveries, the last of which repeats all; the stream is stopped after each and goes on
    from its state. Kept are the first ones of equal texts, and the state has a row for each distinct text."""
    docs = B.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    middle = docs.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0]
    source, path = scratch(spark, "deliveries"), scratch(spark, "single")
    state_rows = 0
    with B.rocksdb(spark):
        for part in (F.col("doc_id") <= middle, F.col("doc_id") > middle, F.lit(True)):
            docs.where(part).write.mode("append").parquet(source)
            stream = spark.readStream.schema(docs.schema).parquet(source)
            single = streams.stream_dedup(stream, F.sha2("text", 256), "doc_id")
            query = single.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
            query.awaitTermination()
            state_rows = sum(s.numRowsTotal for s in query.lastProgress.stateOperators)
    kept = spark.read.parquet(path)
    return kept.agg(F.count("*").alias("kept"), F.lit(state_rows).cast("long").alias("state_rows"), F.sum("doc_id").alias("ids"))


#: Byte c of pixel i of the colour image of a vector: the number c * 21 places further on, as 0 to 255.
_SHIFT = 21


def _hex_bytes(at: list[tuple[int, int]]):
    """The pixels at (position, channel) as hexadecimal digits; each number becomes its byte once."""
    numbers = F.transform("features", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround((x + 1) * 127.5).cast("int")))), 2, "0"))
    wanted = F.array(*(F.lit((i + c * _SHIFT) % 64) for i, c in at))
    return C.bound(numbers, lambda byte: F.array_join(F.transform(wanted, lambda k: F.get(byte, k)), ""))


def _images(spark, sf_dir) -> DataFrame:
    """The vectors as 8x8 images of three colours."""
    data = F.unhex(_hex_bytes([(i, c) for i in range(64) for c in range(3)]))
    shape = [F.lit(v).alias(n) for n, v in (("height", 8), ("width", 8), ("nChannels", 3), ("mode", 16))]
    return B.vectors(spark, sf_dir).select(F.col("sample_id").cast("string").alias("origin"), *shape, data.alias("data"))


def _pixel_sum(rows: DataFrame, *keys: str) -> DataFrame:
    """Pixel bytes summed with their positions as weights, so a value in the wrong place shows."""

    def total(digits):
        return F.aggregate(F.sequence(F.lit(1), F.length("data")), F.lit(0).cast("long"), lambda a, i: a + i * F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))

    value = C.bound(F.hex("data"), total)
    return rows.select(*keys, value.alias("s"))


_BYTES = "bytes AS (SELECT CAST(vec_id AS VARCHAR) AS origin, list_transform(embedding::DOUBLE[], lambda x: greatest(0, least(255, round_even((x + 1) * 127.5, 0)))) AS f FROM embeddings)"
_PIXELS = f"""{_BYTES}, pixels AS (SELECT origin, i, f[i + 1] AS b, f[(i + {_SHIFT}) % 64 + 1] AS g, f[(i + 2 * {_SHIFT}) % 64 + 1] AS r FROM bytes CROSS JOIN (SELECT unnest(range(0, 64)) AS i))"""


def _rows_of(at) -> list[list[float]]:
    """The 8x8 matrix whose row i weights the old positions by at(i): (position, weight) pairs."""
    table = [[0.0] * 8 for _ in range(8)]
    for i in range(8):
        for j, w in at(i):
            table[i][j] += w
    return table


def _between(i: int, old: int, new: int) -> list[tuple[int, float]]:
    """The pixels on both sides of the centre of pixel i, when `old` pixels become `new`."""
    x = min(max((i + 0.5) * old / new - 0.5, 0.0), old - 1.0)
    low = math.floor(x)
    return [(low, 1 - (x - low)), (min(low + 1, old - 1), x - low)]


def _image_matrix(name: str, value: float) -> list[list[float]]:
    """What blur, resampling or crop do along one side of an image of 8 pixels."""
    if name == "blur":
        reach = max(1, math.ceil(3 * value))
        weights = {k: math.exp(-k * k / (2 * value * value)) for k in range(-reach, reach + 1)}
        return _rows_of(lambda i: [(min(max(i + k, 0), 7), w / sum(weights.values())) for k, w in weights.items()])
    if name == "resize":
        small = max(1, int(8 * value))
        return _rows_of(lambda i: [(k, w * v) for j, w in _between(i, small, 8) for k, v in _between(j, 8, small)])
    inner = max(1, int(8 * value))
    return _rows_of(lambda i: [(j + (8 - inner) // 2, w) for j, w in _between(i, inner, 8)])


_SHOWN = "SELECT origin, name, param, CAST(sum((3 * i + k) * greatest(0, least(255, round_even(v, 0)))) AS BIGINT) AS s FROM {0} GROUP BY ALL"


def _image_sweep_sql() -> str:
    """Blur, resampling and crop as matrices on both sides, recompression as rounded cosine sums, of each colour."""
    linear = [(n, p, i, j, w) for n, p, v in corrupt.SWEEP if n in ("blur", "resize", "center_crop") for i, row in enumerate(_image_matrix(n, v)) for j, w in enumerate(row) if w]
    cosines = [(k, i, math.sqrt(2 / 8) * math.cos(math.pi * (2 * i + 1) * k / 16) * (math.sqrt(0.5) if k == 0 else 1)) for k in range(8) for i in range(8)]
    scales = [(p, 50 / q if q < 50 else 2 - q / 50) for n, p, q in corrupt.SWEEP if n == "jpeg"]
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)
    return f"""WITH {_PIXELS}, colours AS (SELECT origin, i // 8 AS y, i % 8 AS x, unnest([1, 2, 3]) AS k, unnest([b, g, r]) AS v FROM pixels),
  side(name, param, new, old, w) AS (VALUES {values(linear)}), wave(f, i, w) AS (VALUES {values(cosines)}), scales(param, scale) AS (VALUES {values(scales)}),
  down AS (SELECT origin, name, param, new AS y, x, k, sum(w * v) AS v FROM colours JOIN side ON old = y GROUP BY ALL),
  both_sides AS (SELECT origin, d.name, d.param, y * 8 + new AS i, k, sum(w * v) AS v FROM down d JOIN side s ON s.name = d.name AND s.param = d.param AND old = x GROUP BY ALL),
  down_f AS (SELECT origin, f AS p, x, k, sum(w * (v - 128)) AS v FROM colours JOIN wave ON i = y GROUP BY ALL),
  coefficients AS (SELECT origin, p, f AS q, k, sum(w * v) AS v FROM down_f JOIN wave ON i = x GROUP BY ALL),
  stepped AS (SELECT *, greatest(1.0, (8 + 6 * (p + q)) * scale) AS step FROM coefficients CROSS JOIN scales),
  kept AS (SELECT origin, param, p, q, k, round_even(round(v / step, 9), 0) * step AS v FROM stepped WHERE round_even(round(v / step, 9), 0) <> 0 OR (p = 0 AND q = 0)),
  back_f AS (SELECT origin, param, i AS y, q, k, sum(w * v) AS v FROM kept JOIN wave ON f = p GROUP BY ALL),
  back AS (SELECT origin, 'jpeg' AS name, param, y * 8 + xx AS i, k, sum(w * v) + 128 AS v FROM back_f b JOIN (SELECT f, i AS xx, w FROM wave) ON f = q GROUP BY ALL),
  clean AS (SELECT origin, 'clean' AS name, '-' AS param, y * 8 + x AS i, k, v FROM colours)
{" UNION ALL ".join(_SHOWN.format(r) for r in ("both_sides", "back", "clean"))}"""


@plan(_image_sweep_sql())
def c3_image_sweep(spark, sf_dir):
    """Colour images under every condition whose values SQL can state without their noise and jitter."""
    conditions = tuple(c for c in corrupt.SWEEP if c[0] not in ("noise", "color_jitter"))
    return _pixel_sum(images.sweep(_images(spark, sf_dir), corrupt.catalogue(spark, conditions), B.SEED), "origin", "name", "param")


def _jittered_sql() -> str:
    """What becomes of channel c of a pixel, rounded half to even and clipped."""
    whole = "CASE WHEN kind = 'contrast' THEN avg(luma) OVER (PARTITION BY origin, param) WHEN kind = 'saturation' THEN luma ELSE 0 END"
    u = B.uniform_sql(f"'{B.SEED}'", "'color_jitter'", "param", "origin", "'factor'")
    value = "greatest(0, least(255, round_even(base + ({c} - base) * factor, 0)))"
    total = " + ".join(f"(3 * i + {k + 1}) * " + value.format(c=c) for k, c in enumerate("bgr"))
    kinds = ", ".join(f"('{p}', '{p.split('_')[0]}', {v})" for n, p, v in corrupt.SWEEP if n == "color_jitter")
    return f"""WITH {_PIXELS}, lit AS (SELECT p.*, k.param, k.kind, k.spread, b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE AS luma FROM pixels p CROSS JOIN (VALUES {kinds}) k(param, kind, spread)),
  based AS (SELECT *, {whole} AS base, 1 - spread::DOUBLE + 2 * spread::DOUBLE * {u} AS factor FROM lit)
SELECT origin, param, CAST(sum({total}) AS BIGINT) AS s FROM based GROUP BY origin, param"""


@plan(_jittered_sql())
def c7_image_jitter(spark, sf_dir):
    """Brightness, contrast and saturation of colour images."""
    conditions = tuple(c for c in corrupt.SWEEP if c[0] == "color_jitter")
    return _pixel_sum(images.sweep(_images(spark, sf_dir), corrupt.catalogue(spark, conditions), B.SEED), "origin", "param")


@plan("SELECT CAST(vec_id AS VARCHAR) AS origin, 192 AS n FROM embeddings")
def c10_image_sizes(spark, sf_dir):
    """Acquisition keeps the sizes of all images."""
    changed = images.acquisition(_images(spark, sf_dir), B.SEED)
    return changed.select("origin", F.length("data").alias("n"))


def _acquisition_sql() -> str:
    def draw(what: str, *more: str) -> str:
        return B.uniform_sql(f"'{B.SEED}'", f"'acquire {what}'", *more, "origin")

    def step(name: str, low: float, high: float) -> str:
        value = f"{low}::DOUBLE + {high - low!r}::DOUBLE * {draw('value', f"'{name}'")}"
        how = f"['{"', '".join(images.HOWS)}'][CAST(floor({draw('how')} * {len(images.HOWS)}) AS INT) + 1]" if name == "resample" else "''"
        return f"{{'h': sha256(concat_ws('|', '{B.SEED}', 'acquire order', '{name}', origin)), 's': '{name} ' || round({value}, 6) || ' ' || {how}}}"

    steps = ", ".join(step(n, *r) for n, r in images.ACQUIRE.items())
    return f"""WITH {_PIXELS}, drawn AS (SELECT CAST(vec_id AS VARCHAR) AS origin FROM embeddings),
  stepped AS (SELECT origin, CASE WHEN {draw('gate')} < {images.ACQUIRE_P} THEN array_to_string(list_transform(list_sort([{steps}])[1:{images.ACQUIRE_NUM}], lambda s: s.s), ', ') ELSE '' END AS steps FROM drawn),
  sums AS (SELECT origin, CAST(sum((3 * i + 1) * b + (3 * i + 2) * g + (3 * i + 3) * r) AS BIGINT) AS s FROM pixels GROUP BY origin)
SELECT origin, steps, CASE WHEN steps = '' THEN s END AS s FROM stepped JOIN sums USING (origin)"""


def _six_places(x):
    """A number rounded to six places, half away from zero, as SQL writes it: 0.000137 and 3.9e-05, where Spark has 1.37E-4 and 3.9E-5."""
    units = F.floor(F.abs(x * 1e6) + 0.5)
    plain = F.regexp_replace(F.format_string("%d.%06d", F.floor(units / 1000000), units % 1000000), "0{1,5}$", "")
    tens = F.concat(F.floor(units / 10).cast("string"), F.when(units % 10 == 0, "").otherwise(F.concat(F.lit("."), (units % 10).cast("string"))), F.lit("e-05"))
    tiny = F.when(units == 0, "0.0").when(units < 10, F.concat(units.cast("string"), F.lit("e-06"))).otherwise(tens)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(units < 100, tiny).otherwise(plain))


@plan(_acquisition_sql())
def c10_acquisition(spark, sf_dir):
    """Which steps every image gets with which values; the pixels of those that get none, which must be the old ones."""
    changed = images.acquisition(_images(spark, sf_dir), B.SEED)
    shown = F.transform("steps", lambda s: F.concat_ws(" ", s["name"], _six_places(s["value"]), F.coalesce(s["how"], F.lit(""))))
    summed = _pixel_sum(changed.withColumn("shown", F.array_join(shown, ", ")), "origin", "shown")
    return summed.select("origin", F.col("shown").alias("steps"), F.when(F.col("shown") != "", None).otherwise(F.col("s")).alias("s"))


_QUARTER = " + ".join(f"(3 * q + {k + 1}) * round_even(avg({c}), 0)" for k, c in enumerate("bgr"))


@plan(f"""WITH {_PIXELS} SELECT origin, 8 AS orig_w, 8 AS orig_h, CAST(sum(s) AS BIGINT) AS s FROM (SELECT origin, q, {_QUARTER} AS s FROM (SELECT *, i // 8 // 2 * 4 + i % 8 // 2 AS q FROM pixels) GROUP BY origin, q) GROUP BY origin""")
def c13_capped_images(spark, sf_dir):
    """Images of 8x8 capped at 4: means of two by two pixels, the old sizes beside them."""
    return _pixel_sum(images.capped(_images(spark, sf_dir), 4), "origin", "orig_w", "orig_h")


#: The means and deviations of red, green and blue that images are standardised with.
_MEANS, _STDS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
_STANDARD = " + ".join(f"(3 * pos + {k + 1}) * CAST(CAST(({c} / 255::DOUBLE - {m}::DOUBLE) / {d}::DOUBLE AS FLOAT) AS DOUBLE)" for k, (c, m, d) in enumerate(zip("rgb", _MEANS, _STDS)))


@plan(f"""WITH {_PIXELS}, placed AS (SELECT *, CASE WHEN {B.uniform_sql(f"'{B.SEED}'", "'flip'", "origin")} < 0.5 THEN i // 8 * 8 + 7 - i % 8 ELSE i END AS pos FROM pixels)
SELECT origin, CAST(3 * count(*) AS INT) AS n, round(sum({_STANDARD}), 3) AS s FROM placed GROUP BY origin""")
def c14_model_features(spark, sf_dir):
    rows = images.features(_images(spark, sf_dir), 8, _MEANS, _STDS, flip_seed=B.SEED)
    total = F.aggregate(F.transform("features", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("origin", F.size("features").alias("n"), F.round(total, 3).alias("s"))


def _key_sql() -> str:
    """Cosine sums of the image stretched to 32x32 between pixel centres: a matrix of 8x8 on each side of the grey values."""
    at = [min(max((j + 0.5) / 4 - 0.5, 0.0), 7.0) for j in range(32)]
    wave = [[math.sqrt(2 / 32) * math.cos(math.pi * (2 * j + 1) * k / 64) * (math.sqrt(0.5) if k == 0 else 1) for j in range(32)] for k in range(8)]
    matrix = [(k, i, sum(wave[k][j] * max(0.0, 1 - abs(at[j] - i)) for j in range(32))) for k in range(8) for i in range(8)]
    values = ", ".join(f"({k}, {i}, {v!r}::DOUBLE)" for k, i, v in matrix)
    return f"""WITH {_PIXELS}, side(k, i, v) AS (VALUES {values}), low AS (SELECT origin, a.k * 8 + c.k AS pos, sum(a.v * c.v * (b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE)) AS x
  FROM pixels p JOIN side a ON a.i = p.i // 8 JOIN side c ON c.i = p.i % 8 GROUP BY ALL),
  bits AS (SELECT origin, pos, CASE WHEN x > median(x) OVER (PARTITION BY origin) THEN 1 ELSE 0 END AS bit FROM low)
SELECT origin, string_agg(format('{{:x}}', digit), '' ORDER BY d) AS phash FROM (SELECT origin, pos // 4 AS d, CAST(sum(bit * (8 >> CAST(pos % 4 AS INT))) AS BIGINT) AS digit FROM bits GROUP BY ALL) GROUP BY origin"""


@plan(_key_sql())
def sc8_image_keys(spark, sf_dir):
    return images.perceptual_keys(_images(spark, sf_dir))


def _bitmaps(spark, sf_dir) -> DataFrame:
    """(name, content): each vector as a 24-bit bitmap file of 8x8 pixels, its rows from below; of each tenth one the
    first bytes only."""
    header = b"BM" + struct.pack("<IHHI", 54 + 192, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 24, 0, 192, 2835, 2835, 0, 0)
    body = _hex_bytes([(y * 8 + x, c) for y in range(7, -1, -1) for x in range(8) for c in range(3)])
    whole = F.concat(F.lit(header.hex()), body)
    digits = F.when(F.col("sample_id") % 10 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    return B.vectors(spark, sf_dir).select(F.col("sample_id").alias("name"), F.unhex(digits).alias("content"))


@plan(f"""WITH {_PIXELS}, files AS (SELECT origin, CAST(sum((3 * i + 1) * b + (3 * i + 2) * g + (3 * i + 3) * r) AS BIGINT) AS s FROM pixels GROUP BY origin)
SELECT 'unreadable image' AS "check", 'error' AS severity, count(*) FILTER (origin::BIGINT % 10 = 0) AS n, count(*) FILTER (origin::BIGINT % 10 <> 0) AS decoded, CAST(sum(s) FILTER (origin::BIGINT % 10 <> 0) AS BIGINT) AS s FROM files""")
def v8_readability(spark, sf_dir):
    """Every vector is written as an image file, each tenth one cut off; the files are decoded, the broken ones found, and
    the pixels of the others summed."""
    path = scratch(spark, "bitmaps")
    name = F.concat(F.format_string("%02d/", F.col("name") % _FOLDERS), F.col("name"), F.lit(".bmp"))
    listing.write_files(_bitmaps(spark, sf_dir), path, name, F.col("content")).write.format("noop").mode("overwrite").save()
    # Files are opened and decoded once; what is wanted of them is kept. Spark deals some thirty small files to a task, which are
    # put together, some tasks a core, so no file of results is left for each thirty.
    found = images.read(spark, path).coalesce(4 * spark.sparkContext.defaultParallelism)
    rows = B.stored(_pixel_sum(found, "origin", "height"), "decoded")
    decoded = rows.where("height > 0").agg(F.count("*").alias("decoded"), F.sum("s").alias("s"))
    return verify.readability(rows).drop("examples").crossJoin(decoded)


@plan("SELECT CAST(vec_id AS BIGINT) AS sample_id, round(-list_sum(embedding::DOUBLE[]), 6) AS s FROM embeddings")
def u1_user_kernel(spark, sf_dir):
    corrupt.add("negative", lambda v, value, *seed: F.transform(v, lambda x: -x))
    rows = corrupt.sweep(B.vectors(spark, sf_dir).select("sample_id", "features"), B.SEED, (("negative", "-", None),), lengths=B.LENGTHS)
    corrupt.remove("negative")
    return rows.select("sample_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


_TOLD = ", ".join(f"('{n}', '{t.parameter}', {v})" for n, t in corrupt.TRANSFORMS.items() for v in t.values)


@plan(f"SELECT name, parameter, value::DOUBLE AS value, (SELECT count(*) FROM embeddings) AS n FROM (VALUES {_TOLD}) t(name, parameter, value)")
def u1_described(spark, sf_dir):
    """What the registry says of each transform, and how many vectors come out of a sweep of all its values."""
    told = corrupt.described(spark).select("name", "parameter", F.explode("values").alias("value"))
    conditions = tuple((r.name, str(r.value), r.value) for r in told.collect())
    swept = corrupt.sweep(B.vectors(spark, sf_dir).select("sample_id", "features"), B.SEED, conditions, lengths=B.LENGTHS)
    return swept.where("size(features) = 64").groupBy("name", "value").agg(F.count("*").alias("n")).join(F.broadcast(told), ["name", "value"])
