"""Question files: labelled items with their signals inside, or found by index in a data file beside.

Items and containers are JSON of any shape and depth. Scalars are read as VARIANT, which tells a number from a
text of digits; containers are walked as maps from JSON, level by level, as texts follow the file's order of
channels and VARIANT sorts its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..shared import persist

# Where an item's label, index and signals may stand, in order of preference, and named labels.
LABEL_KEYS = ("label", "majority_label_original", "majority_label", "class_label", "target", "y")
INDEX_KEYS = ("index", "data_index", "local_index")
CONTAINERS = ("signals", "data", "features")
PLACES = ("chest", "wrist")
LABELS = {
    "Non-stress": 0, "No stress": 0, "No-stress": 0, "Baseline": 0, "Amusement": 0, "Meditation": 0, "Recovery": 0, "Stress": 1,
}
THREE_AXES = ("chest_acc", "wrist_acc", "acc", "gyro")
#: The key of a data file that is an object as a whole.
WHOLE = "*"
_FAST = {"mode": "FAILFAST"}
_MAP = "map<string,string>"


def _is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def _entries(text: Column) -> Column:
    """The entries of a JSON object in its order, values as JSON (texts without quotes)."""
    return F.map_entries(F.from_json(F.when(_is_object(text), text).otherwise(F.lit("{}")), _MAP))


def _get(entries: Column, key: str) -> Column:
    """The value of a key, the last where it repeats."""
    return F.get(F.reverse(F.filter(entries, lambda e: e["key"] == key)), F.lit(0))["value"]


def _container(text: Column) -> Column:
    """The first of an object's containers that is an object; null if none is."""
    found = [F.when(_is_object(v), v) for v in (_get(_entries(text), k) for k in CONTAINERS)]
    return F.coalesce(*found)


def _lines(spark: SparkSession, path: str) -> bool:
    """Whether a path holds one object a line: ``.jsonl`` files, or a folder of parts that Spark wrote."""
    return path.rstrip("/").endswith(("jsonl", "jsonl.gz", "jsonl.zst"))


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``value``: whole files, or their lines."""
    read = spark.read.text(path, wholetext=not _lines(spark, path))
    return read.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\ufeff", "").alias("value")).filter("trim(value) <> ''")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of question files, ``path, place, item`` (JSON): a list under ``dataset``, a bare list, or a line each.

    A file that is no JSON is an error; an object without ``dataset`` has no items.
    """
    payloads = _payloads(spark, path)
    if _lines(spark, path):
        return payloads.select("path", F.monotonically_increasing_id().alias("place"), F.col("value").alias("item"))
    bare = F.ltrim("value").startswith("[")
    listed = F.from_json(F.when(bare, F.col("value")), "array<string>", _FAST)
    under = F.from_json(F.when(~bare, F.col("value")), "struct<dataset:array<string>>", _FAST)["dataset"]
    return payloads.select("path", F.posexplode(F.coalesce(listed, under)).alias("place", "item")).withColumn("place", F.col("place").cast("bigint"))


def read_data(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """What items find by index, ``key, value`` (JSON), and the length if the file is a list.

    JSON lists (keys are places), objects (and the object as a whole under :data:`WHOLE`), lines with an ``index``
    of their own, or a trusted pickle of a list or a dict: pickles run code, and one is one task.
    """
    if path.endswith((".pkl", ".pickle")):
        return _read_pickle(spark, path)
    payloads = _payloads(spark, path)
    if _lines(spark, path):
        return payloads.select(_get(_entries(F.col("value")), "index").alias("key"), "value").filter("key is not null"), None
    first = payloads.select(F.ltrim("value").startswith("[").alias("bare")).first()
    if first and first["bare"]:
        rows = payloads.select(F.posexplode(F.from_json("value", "array<string>", _FAST)).alias("key", "value"))
        return rows.select(F.col("key").cast("string"), "value"), rows.count()
    rows = payloads.select(F.explode(F.concat(F.array(F.struct(F.lit(WHOLE).alias("key"), F.col("value").alias("value"))), _entries(F.col("value")))).alias("e"))
    return rows.select("e.key", "e.value"), None


def _read_pickle(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    def unpack(batches):
        import json
        import pickle

        import pandas as pd

        shown = lambda v: json.dumps(v, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))
        for pdf in batches:
            for content in pdf["content"]:
                data = pickle.loads(bytes(content))
                if isinstance(data, dict):
                    data = {str(k): v for k, v in data.items()}
                    yield pd.DataFrame({"key": [WHOLE, *data], "value": [shown(data), *map(shown, data.values())], "n": None}).astype({"n": "Int64"})
                elif isinstance(data, list):
                    yield pd.DataFrame({"key": map(str, range(len(data))), "value": map(shown, data), "n": len(data)})

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = persist(files.mapInPandas(unpack, "key string, value string, n long"), "data-file")
    return rows.select("key", "value"), rows.agg(F.max("n")).first()[0]


def item_label(item: Column, labels: dict[str, int] = LABELS) -> Column:
    """The label of the first key that holds a whole number, or the name of a label; null if none does."""
    v = F.try_parse_json(item)
    found = []
    for key in LABEL_KEYS:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        number = F.when(~kind.isin("STRING", "VOID"), F.try_variant_get(v, f"$.{key}", "double").try_cast("int"))
        text = F.try_variant_get(v, f"$.{key}", "string")
        found.append(F.coalesce(number, F.when(kind == "STRING", F.coalesce(C.coerced_label(text), C.lookup(labels, text)))))
    return F.coalesce(*found)


def flattened(containers: DataFrame) -> DataFrame:
    """``id, signals`` (``name, value`` in order) of containers ``id, value`` (JSON objects), nested to any depth.

    ``signal`` stands for its container; channels below ``chest`` and ``wrist`` take the place into their name;
    ``signals``, ``data``, ``features`` and ``signal`` are containers themselves. Of channels that repeat a name the
    last counts, where the first stood. A pass handles one level of all rows.
    """
    todo, found, depth = containers.select("id", F.array().cast("array<int>").alias("at"), "value"), None, 0
    while True:
        entries = _entries(F.col("value"))
        inner = _get(entries, "signal")
        rows = todo.select("id", "at", F.posexplode(F.when(_is_object(inner), _entries(inner)).otherwise(entries)).alias("n", "e"))
        rows = rows.select("id", F.concat("at", F.array("n")).alias("at"), F.col("e.key").alias("name"), F.col("e.value").alias("value"))
        rows = persist(rows.withColumn("key", F.lower(F.trim(F.translate("name", "- ", "__")))).withColumn("object", _is_object(F.col("value"))), f"level{depth}")
        placed = F.col("object") & F.col("key").isin(*PLACES)
        nested = F.col("object") & F.col("key").isin(*CONTAINERS, "signal")
        below = rows.filter(placed).select("id", "at", "key", F.posexplode(_entries(F.col("value"))).alias("n", "e"))
        name = F.concat_ws("_", "key", F.lower(F.trim(F.translate(F.col("e.key"), "- ", "__"))))
        leaves = rows.filter(~placed & ~nested).select("id", "at", "name", "value")
        leaves = leaves.unionByName(below.select("id", F.concat("at", F.array("n")).alias("at"), name.alias("name"), F.col("e.value").alias("value")))
        found = leaves if found is None else found.unionByName(leaves)
        todo, depth = rows.filter(nested).select("id", "at", "value"), depth + 1
        if not todo.limit(1).count():
            break
    last = found.groupBy("id", "name").agg(F.min("at").alias("at"), F.max_by("value", "at").alias("value"))
    listed = F.array_sort(F.collect_list(F.struct("at", "name", "value")))
    return last.groupBy("id").agg(F.transform(listed, lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"))).alias("signals"))


def _numbers(text: Column) -> Column:
    """All numbers of a JSON value, lists of lists in order; what is no number goes."""
    flat = F.when(F.ltrim(text).startswith("["), F.concat(F.lit("["), F.regexp_replace(text, r"[\[\]]", ""), F.lit("]"))).otherwise(F.to_json(F.array(text)))
    cells = F.from_json(F.when(~_is_object(text), flat), "array<string>")
    return F.coalesce(F.filter(F.transform(cells, C.number), lambda v: v.isNotNull()), F.array().cast("array<double>"))


def signal(name: Column, value: Column) -> Column:
    """``struct<name, x, y, z>`` of a channel's JSON: three axes where the name is of such a sensor and the shape fits."""
    rows = F.from_json(F.when(F.ltrim(value).rlike(r"^\[\s*\["), value), "array<array<string>>")
    key = F.lower(F.trim(F.translate(name, "- ", "__")))
    wide = key.isin(*THREE_AXES) & F.coalesce((F.size(rows) > 0) & F.forall(rows, lambda r: F.size(r) == 3), F.lit(False))
    long = key.isin(*THREE_AXES) & ~wide & F.coalesce((F.size(rows) == 3) & F.forall(rows, lambda r: F.size(r) == F.size(F.get(rows, F.lit(0)))), F.lit(False))
    clean = lambda cells: F.filter(F.transform(cells, C.number), lambda v: v.isNotNull())
    axis = lambda i: F.when(wide, clean(F.transform(rows, lambda r: F.get(r, F.lit(i))))).when(long, clean(F.get(rows, F.lit(i))))
    return F.struct(name.alias("name"), F.coalesce(axis(0), _numbers(value)).alias("x"), axis(1).alias("y"), axis(2).alias("z"))


def question_samples(
    spark: SparkSession, path: str, data_path: str | None = None, subjects: list[str] | None = None, wanted: list[int] | None = None, labels: dict[str, int] = LABELS
) -> DataFrame:
    """Samples of question files: ``subject, label, signals`` and where each came from.

    A label must be explicit; it never comes from an answer, and an item of a chosen subject without one is an
    error. Signals stand in the item or, if it has none, in the data file at its index: a place of a list (negative
    ones count from the end) or a key of an object; without an index the object as a whole. Items whose signals
    are nowhere have an empty list. ``wanted`` keeps these labels; no subjects or labels given keep all.
    """
    items = read_items(spark, path).withColumn("v", F.try_parse_json("item"))
    has = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")).isNotNull()
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    whole = lambda k: F.try_variant_get("v", f"$.{k}", "bigint")
    index = F.lit(None).cast("string")
    for k in reversed(INDEX_KEYS):
        index = F.when(has(k), text(k)).otherwise(index)
    rows = items.select(
        "path", "place", "item", F.coalesce(text("subject"), F.lit("")).alias("subject"), item_label(F.col("item"), labels).alias("label"), index.alias("data_key"),
        whole("index").alias("data_index"), F.coalesce(F.try_variant_get("v", "$.qa_pair.Q", "string"), F.lit("")).alias("question"),
        *(whole(k).alias(k) for k in ("local_index", "start_index", "end_index")),
    )
    if subjects:
        rows = rows.filter(F.col("subject").isin(subjects))
    rows = persist(rows.withColumn("id", F.struct("path", "place")), "items")
    bad = rows.filter("label is null").select("path", "place").orderBy("path", "place").first()
    if bad:
        raise ValueError(f"item {bad['place']} of {bad['path']} has no explicit label under any of {', '.join(LABEL_KEYS)}")
    if wanted:
        rows = rows.filter(F.col("label").isin(wanted))
    rows = rows.withColumn("own", _container(F.col("item")))
    containers = rows.filter("own is not null").select("id", F.col("own").alias("value"))
    if data_path:
        data, n = read_data(spark, data_path)
        if n is not None:
            place = F.col("data_key").try_cast("bigint")
            key = F.when(place < 0, place + n).otherwise(place).cast("string")
        else:
            key = F.coalesce("data_key", F.lit(WHOLE))
        met = rows.filter("own is null").withColumn("key", key).join(data, "key").filter(_is_object(F.col("value")))
        containers = containers.unionByName(met.select("id", F.coalesce(_container(F.col("value")), "value").alias("value")))
    found = flattened(persist(containers, "containers")).withColumn("signals", F.transform("signals", lambda s: signal(s["name"], s["value"])))
    out = rows.join(found, "id", "left").withColumn("signals", F.filter("signals", lambda s: (F.size(s["x"]) > 0)))
    none = F.array().cast("array<struct<name:string,x:array<double>,y:array<double>,z:array<double>>>")
    return out.select(
        "subject", "label", F.coalesce("signals", none).alias("signals"), F.lit(data_path or "").alias("data_path"), F.col("path").alias("qa_path"), "place", "data_index",
        "question", F.col("path").alias("source"), "local_index", "start_index", "end_index",
    )
