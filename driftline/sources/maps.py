"""Map and trajectory files: road XML, road JSON from services, prepared graphs and vehicle trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import number

_TAG = "array<struct<_k:string,_v:string>>"


def read_road_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of a road file: nodes (node, lat, lon) with numbers only, ways (way, refs, tags)."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _lat string, _lon string").load(path)
    nodes = nodes.select(F.col("_id").alias("node"), number(F.col("_lat")).alias("lat"), number(F.col("_lon")).alias("lon")).where("node is not null and lat is not null and lon is not null")
    ways = spark.read.format("xml").option("rowTag", "way").schema(f"_id string, nd array<struct<_ref:string>>, tag {_TAG}").load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast(_TAG)), lambda t: F.struct(t["_k"], t["_v"])))
    return nodes, ways.select(F.col("_id").alias("way"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), tags.alias("tags"))


def origin(nodes: DataFrame) -> tuple[float, float]:
    """The mean of all nodes, as the origin of the local plane."""
    row = nodes.agg(F.avg("lat"), F.avg("lon")).first()
    return row[0], row[1]


def read_road_service(spark: SparkSession, path: str) -> DataFrame:
    """(way, pos, node, lat, lon, tags) of a road service's answer; one with a remark is incomplete and an error."""
    form = "remark string, elements array<struct<type:string,id:long,nodes:array<long>,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"
    answer = spark.read.option("multiLine", True).schema(form).json(path)
    whole = answer.where(F.when(F.col("remark").isNotNull(), F.raise_error(F.lit("the answer is incomplete"))).otherwise(F.lit(True)).cast("boolean"))
    ways = whole.select(F.explode("elements").alias("w")).where("w.type = 'way'")
    points = ways.select(F.col("w.id").alias("way"), F.col("w.tags").alias("tags"), F.posexplode(F.arrays_zip("w.nodes", "w.geometry")).alias("pos", "p"))
    return points.select("way", "pos", F.col("p.nodes").alias("node"), F.col("p.geometry.lat").alias("lat"), F.col("p.geometry.lon").alias("lon"), "tags")


ARC = "segment_id long, way_id string, start_node string, end_node string, start_e_m double, start_n_m double, end_e_m double, end_n_m double, length_m double, bearing_deg double, highway string, name string, tunnel string, bridge string, layer long"


#: Limits of a prepared graph (fixed values): arcs, bytes of its file, metres from the origin and of an arc, cell sizes.
MOST_ARCS, MOST_BYTES, FARTHEST, LONGEST, CELLS = 60_000, 25 << 20, 200_000.0, 10_000.0, (10.0, 1000.0)
_GRAPH = "schema_version int, format string, origin_latitude_deg double, origin_longitude_deg double, cell_size_m double, attribution string"


def _required(column: Column, holds: Column, said: str, value: Column) -> Column:
    """``column`` where ``holds``; else an error that names the field's bound and the value found."""
    what = F.concat(F.lit(f"{said}, found "), F.coalesce(value.cast("string"), F.lit("nothing")))
    return F.when(F.coalesce(holds, F.lit(False)), column).otherwise(F.raise_error(what))


def _graphs(spark: SparkSession, path: str, name: str, most: int) -> DataFrame:
    form = f"{_GRAPH}, arcs array<struct<{ARC.replace(' ', ':').replace(',:', ',')}>>"
    document = spark.read.option("multiLine", True).schema(form).json(path).withColumn("_bytes", F.col("_metadata.file_size"))
    rules = [
        ("schema_version", F.col("schema_version") == 1, "unsupported road graph: schema_version is 1", F.col("schema_version")),
        ("format", F.col("format") == name, f"unsupported road graph: format is {name}", F.col("format")),
        ("origin_latitude_deg", F.col("origin_latitude_deg").between(-90, 90), "origin_latitude_deg lies in [-90, 90]", F.col("origin_latitude_deg")),
        ("origin_longitude_deg", F.col("origin_longitude_deg").between(-180, 180), "origin_longitude_deg lies in [-180, 180]", F.col("origin_longitude_deg")),
        ("arcs", F.size("arcs").between(1, most), f"a graph has 1 to {most} arcs", F.size("arcs")),
        ("_bytes", F.col("_bytes").between(1, MOST_BYTES), f"a graph file has 1 to {MOST_BYTES} bytes", F.col("_bytes")),
    ]
    document = document.withColumn("cell_size_m", F.coalesce("cell_size_m", F.lit(60.0)))
    rules.append(("cell_size_m", F.col("cell_size_m").between(*CELLS), f"cell_size_m lies in {list(CELLS)}", F.col("cell_size_m")))
    return document.select(*[_required(F.col(c), holds, said, value).alias(c) for c, holds, said, value in rules], "attribution")


def read_graph(spark: SparkSession, path: str, name: str, most: int = MOST_ARCS) -> DataFrame:
    """Arcs of prepared graph files of the given format name.

    A file that is too large, lacks its origin or has no arc or over ``most``, and an arc out of range (coordinates
    beyond 200 km, straight or given length over 10 km, a length that isn't positive), is an error that names the field.
    """
    graph = _graphs(spark, path, name, most)
    # all rules of the document are looked at, also those whose columns nobody reads
    whole = graph.where(F.col("schema_version").isNotNull() & F.col("format").isNotNull() & F.col("origin_latitude_deg").isNotNull() & F.col("origin_longitude_deg").isNotNull() & F.col("cell_size_m").isNotNull() & F.col("_bytes").isNotNull())
    arcs = whole.select(F.inline("arcs"))
    near = [_required(F.col(c), F.abs(c) <= FARTHEST, f"{c} lies within {FARTHEST} m", F.col(c)).alias(c) for c in ("start_e_m", "start_n_m", "end_e_m", "end_n_m")]
    straight = F.hypot(F.col("end_e_m") - F.col("start_e_m"), F.col("end_n_m") - F.col("start_n_m"))
    length = _required(F.col("length_m"), (F.col("length_m") > 0) & (F.col("length_m") < float("inf")) & (straight <= LONGEST), f"length_m is above 0, and an arc's ends within {LONGEST} m", F.col("length_m"))
    told = {"start_e_m": near[0], "start_n_m": near[1], "end_e_m": near[2], "end_n_m": near[3], "length_m": length.alias("length_m")}
    return arcs.select(*[told.get(c.split()[0], F.col(c.split()[0])) for c in ARC.split(", ")])


def graph_origins(spark: SparkSession, path: str, name: str, most: int = MOST_ARCS) -> DataFrame:
    """(file, origin_latitude_deg, origin_longitude_deg, cell_size_m, attribution): where each graph's plane lies."""
    return _graphs(spark, path, name, most).select(F.input_file_name().alias("file"), "origin_latitude_deg", "origin_longitude_deg", "cell_size_m", "attribution")


def write_graph(arcs: DataFrame, path: str, name: str, at: tuple[float, float], cell: float = 60.0, attribution: str | None = None) -> None:
    """One JSON document of a prepared graph around the origin ``at``: a bounded extract, as the format is one document."""
    fields = [F.col(c.split()[0]) for c in ARC.split(", ")]
    document = arcs.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("arcs"))
    head = {"schema_version": 1, "format": name, "origin_latitude_deg": float(at[0]), "origin_longitude_deg": float(at[1]), "cell_size_m": float(cell), "attribution": attribution}
    document.select(*[F.lit(v).cast("string" if v is None else type_of(v)).alias(k) for k, v in head.items()], "arcs").coalesce(1).write.mode("overwrite").json(path)


def type_of(value: object) -> str:
    return {int: "int", float: "double", str: "string"}[type(value)]


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """(vehicle, t, x, y, angle, speed) of a trajectory file; rows with text for a number or nothing are left out."""
    form = "_time string, vehicle array<struct<_id:string,_x:string,_y:string,_angle:string,_speed:string>>"
    steps = spark.read.format("xml").option("rowTag", "timestep").schema(form).load(path)
    rows = steps.select(number(F.col("_time")).alias("t"), F.explode("vehicle").alias("v"))
    out = rows.select(F.col("v._id").alias("vehicle"), "t", *[number(F.col(f"v._{c}")).alias(c) for c in ("x", "y", "angle", "speed")])
    return out.dropna()


def route_steps(answers: DataFrame, text: str = "value") -> DataFrame:
    """(pos, lat, lon, say, distance, so_far) of a routing service's first route."""
    form = "routes array<struct<legs:array<struct<steps:array<struct<distance:double,name:string,maneuver:struct<type:string,modifier:string,location:array<double>>>>>>>>"
    from pyspark.sql import Window

    legs = answers.select(*[c for c in answers.columns if c != text], F.from_json(text, form).alias("r")).select(*[c for c in answers.columns if c != text], F.posexplode(F.flatten(F.transform(F.col("r.routes")[0]["legs"], lambda leg: leg["steps"]))).alias("pos", "s"))
    keys = [c for c in answers.columns if c != text]
    place = F.concat_ws(" ", F.initcap("s.maneuver.type"), "s.maneuver.modifier", F.when(F.trim("s.name") != "", F.concat(F.lit("onto "), "s.name")))
    so_far = F.sum("s.distance").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return legs.select(*keys, "pos", F.col("s.maneuver.location")[1].alias("lat"), F.col("s.maneuver.location")[0].alias("lon"), place.alias("say"), F.col("s.distance").alias("distance"), F.coalesce(so_far, F.lit(0.0)).alias("so_far"))


def places(answers: DataFrame, text: str = "value") -> DataFrame:
    """(pos, name, detail, lat, lon) of a geocoder's answer: the first name there is, and up to three distinct details."""
    form = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<name:string,street:string,city:string,district:string,state:string,country:string>>>"
    keys = [c for c in answers.columns if c != text]
    rows = answers.select(*keys, F.posexplode(F.from_json(text, form)["features"]).alias("pos", "f"))
    filled = lambda c: F.nullif(F.trim(F.col(f"f.properties.{c}")), F.lit(""))
    details = F.slice(F.array_distinct(F.array_compact(F.array(*[filled(c) for c in ("street", "district", "city", "state", "country")]))), 1, 3)
    return rows.select(*keys, "pos", F.coalesce(filled("name"), filled("street"), filled("city")).alias("name"), F.array_join(details, ", ").alias("detail"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"))
