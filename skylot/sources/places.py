"""Stations and buildings from tables and workbooks, in English names and one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from skylot.sources.workbook import sheets

STATION = ("source_sheet string, latitude double, longitude double, station_name string, city string, platform string, notes string, additional_notes string, "
           "service_start_date string, service_end_date string, service_start_date_is_estimated boolean, service_end_date_is_estimated boolean")
BUILDING = ("wkt_geometry string, feature_id double, building_height_m double, roof_area_sqm double, land_use_type string, province string, city string, "
            "ground_elevation_m double, top_elevation_m double, longitude double, latitude double")
#: How sheets, columns and their values are called.
SHEETS = {"顺丰": "sf_express", "美团": "meituan"}
NAME, PLATFORM, PERIOD, NOTES, CITY = ("航站名称", "站点名"), ("运营方", "平台"), ("服务时间", "开通时间"), ("备注",), ("城市",)
LATITUDE, LONGITUDE, EIGHTH = ("纬度",), ("经度",), 7
CITIES = {"深圳": "Shenzhen", "北京": "Beijing", "上海": "Shanghai", "东莞": "Dongguan", "中山": "Zhongshan", "南京": "Nanjing", "呼和浩特": "Hohhot", "海口": "Haikou",
          "湛江": "Zhanjiang", "珠海": "Zhuhai", "黄石": "Huangshi"}
PLATFORMS = {"顺丰丰翼": "SF Express Fengyi", "美团": "Meituan"}
SAID = {"测试站": "test_site", "新开站": "new_site", "已关闭？": "possibly_closed"}
SAID_TOO = {"10.24时搜不到了": "not_found_when_checked_on_oct_24"}
#: Parts of station names, in the order in which they are put into English.
NAME_PARTS = {
    "无人机空投柜": " Drone Drop Cabinet ", "无人机收餐点": " Drone Meal Pickup Point ", "无人机": " Drone ", "网点航站": " Outlet Air Station ", "航站": " Air Station ",
    "中转场": " Transfer Hub ", "集散中心": " Distribution Center ", "集散": " Distribution Hub ", "工业园": " Industrial Park ", "工业区": " Industrial Area ",
    "体育公园": " Sports Park ", "运动公园": " Sports Park ", "中心公园": " Central Park ", "公园店": " Park Store ", "公园": " Park ", "商业中心": " Commercial Center ",
    "街道办": " Subdistrict Office ", "社区": " Community ", "图书馆北馆": " Library North Branch ", "图书馆中心馆": " Library Central Branch ", "图书馆": " Library ",
    "口岸前广场": " Port Front Plaza ", "前广场": " Front Plaza ", "口岸": " Port ", "国际研究生院": " International Graduate School ", "研究生院": " Graduate School ",
    "研究院": " Research Institute ", "先进院": " Institute of Advanced Technology ", "校区": " Campus ", "东区": " East Area ", "宿舍": " Dormitories ", "长城": " Great Wall ",
    "商场": " Mall ", "广场": " Plaza ", "大道": " Avenue ", "园区": " Campus ", "篮球场": " Basketball Court ", "测试场": " Test Field ", "生产测试": " Production Test ",
    "测试": " Test ", "研发": " R&D ", "水泥地": " Concrete Pad ", "丰翼配送": "Fengyi Delivery ", "丰翼": "Fengyi ", "美团": "Meituan ", "丰巢": "Fengchao ",
    "北京大学": "Peking University ", "清华大学": "Tsinghua University ", "复旦大学": "Fudan University ", "中科院": "CAS "}
HEALTHCARE, RESIDENTIAL = "medical_and_healthcare_land", "residential_land"
LAND_USES = {"交通场站用地": "transportation_station_land", "体育与文化用地": "sports_and_cultural_land", "公园与绿地用地": "park_and_green_space_land", "医疗卫生用地": HEALTHCARE,
             "商业服务用地": "commercial_service_land", "商务办公用地": "business_office_land", "居住用地": RESIDENTIAL, "工业用地": "industrial_land",
             "教育科研用地": "education_and_research_land", "行政办公用地": "administrative_office_land"}
PROVINCES, TOWNS = {"广东省": "Guangdong", "Guangdong Province": "Guangdong"}, {"深圳市": "Shenzhen", "Shenzhen City": "Shenzhen"}
BUILDING_NAMES = {"wkt_geom": "wkt_geometry", "fid": "feature_id", "Height": "building_height_m", "height": "building_height_m", "roof_area": "roof_area_sqm", "type": "land_use_type",
                  "DEM高度": "ground_elevation_m", "求和高度": "top_elevation_m", "经度": "longitude", "lon": "longitude", "纬度": "latitude", "lat": "latitude"}
CHINESE = "[\\u4e00-\\u9fff]"


def _translated(value: Column, table: dict[str, str]) -> Column:
    """What a table says for a value, without the spaces round it; other values stay, null is empty."""
    text = F.trim(F.coalesce(value, F.lit("")))
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(pairs, text), text)


def station_name(name: Column) -> Column:
    text = F.trim(F.coalesce(name, F.lit("")))
    for source, target in NAME_PARTS.items():
        text = F.replace(text, F.lit(source), F.lit(target))
    for pattern, target in ((r"(\d+)\s*期", "Phase $1 "), ("区-", " District - "), ("区", " District "), (r"\s+", " "), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s*-\s*", " - ")):
        text = F.regexp_replace(text, pattern, target)
    return F.btrim(text, F.lit(" -"))


_DATED = r"^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日(？)?$"


def service_date(token: Column) -> Column:
    """A spreadsheet's day number, or a dated text that may be marked as estimated, as an ISO date; empty for what is neither."""
    part = lambda i: F.regexp_extract(token, _DATED, i)
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(token.try_cast("double")).cast("int")).cast("string")
    written = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(token.rlike(r"^[0-9]+([.][0-9]+)?$"), day).when(token.rlike(_DATED), written).otherwise("")


def service_period(said: Column) -> Column:
    """The dates of a period 'start-end'; what is no date of service fails. An empty period, or one without an end, has
    empty dates."""
    halves = F.split(F.trim(F.coalesce(said, F.lit(""))), "-", 2)
    tokens = [F.trim(F.coalesce(F.get(halves, i), F.lit(""))) for i in (0, 1)]
    dates = [service_date(t) for t in tokens]
    wrong = [F.raise_error(F.concat(F.lit("not a date of service: "), t)).cast("string") for t in tokens]
    starts, ends = (F.when((d == "") & (t != ""), w).otherwise(d) for t, d, w in zip(tokens, dates, wrong, strict=True))
    early, late = (F.regexp_extract(t, _DATED, 4) != "" for t in tokens)
    return F.struct(starts.alias("service_start_date"), ends.alias("service_end_date"), early.alias("service_start_date_is_estimated"), late.alias("service_end_date_is_estimated"))


def in_english(rows: DataFrame) -> DataFrame:
    """rows, failing where Chinese text is left in a text column."""
    checked = {f.name: F.when(F.col(f.name).rlike(CHINESE), F.raise_error(F.concat(F.lit(f"{f.name} isn't translated: "), F.col(f.name)))).otherwise(F.col(f.name))
               for f in rows.schema.fields if isinstance(f.dataType, StringType)}
    return rows.withColumns(checked)


def typed(rows: DataFrame, ddl: str, path: str) -> DataFrame:
    """The columns of a schema, cast strictly; one that is missing fails."""
    wanted = StructType.fromDDL(ddl)
    if missing := [f.name for f in wanted.fields if f.name not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    cast = lambda f: F.coalesce(f.name, F.lit("")) if isinstance(f.dataType, StringType) else F.trim(f.name).cast(f.dataType)
    return rows.select(*(cast(f).alias(f.name) for f in wanted.fields))


def table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or the first sheet of a workbook, as texts by column name."""
    if path.lower().endswith(".csv"):
        return spark.read.option("header", "true").csv(path)
    if not path.lower().endswith(".xlsx"):
        raise ValueError(f"neither .csv nor .xlsx: {path}")
    rows = sheets(spark, path)
    sheet, _, names = rows.orderBy("row").first()
    body = rows.filter((F.col("sheet") == sheet) & (F.col("row") > 1))
    return body.select(*(F.get("cells", i).alias(n) for i, n in enumerate(names) if n))


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations of a CSV file in this form already, or of all sheets of a workbook that hold rows below their names."""
    if not path.lower().endswith(".xlsx"):
        return in_english(typed(table(spark, path), STATION, path))
    rows = sheets(spark, path)
    first = F.min_by("cells", "row")
    heads = rows.groupBy(F.col("sheet").alias("_sheet")).agg(first.alias("names"), F.min("row").alias("top"))
    heads = heads.select("_sheet", "top", F.transform("names", lambda n: F.trim(F.coalesce(n, F.lit("")))).alias("names"))
    body = rows.join(F.broadcast(heads), rows["sheet"] == heads["_sheet"]).filter("row > top")  # one row a sheet
    if body.isEmpty():
        raise ValueError(f"no sheet of {path} has rows")
    at = lambda *names: F.coalesce(*(F.when(F.array_position("names", n) > 0, F.get("cells", (F.array_position("names", n) - 1).cast("int"))) for n in names))
    asked = {"latitude": LATITUDE, "longitude": LONGITUDE, "name": NAME, "city": CITY, "platform": PLATFORM, "period": PERIOD, "notes": NOTES}
    lacking = F.array_compact(F.array(*(F.when(~F.arrays_overlap("names", F.array(*map(F.lit, names))), names[0]) for names in asked.values())))
    told = body.select("sheet", F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("the sheet lacks "), F.array_join(lacking, ", "))).cast("string")).otherwise(F.lit("")).alias("_fault"),
                       *(at(*names).alias(k) for k, names in asked.items()), F.when(F.coalesce(F.get("names", EIGHTH), F.lit("")) == "", F.get("cells", EIGHTH)).alias("more"))
    told = told.withColumn("dates", service_period(F.col("period")))
    out = told.select(F.concat(_translated(F.col("sheet"), SHEETS), "_fault").alias("source_sheet"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"),
                      station_name(F.col("name")).alias("station_name"), _translated(F.col("city"), CITIES).alias("city"), _translated(F.col("platform"), PLATFORMS).alias("platform"),
                      _translated(F.col("notes"), SAID).alias("notes"), _translated(F.col("more"), SAID_TOO).alias("additional_notes"), "dates.*")
    return in_english(out)


def buildings(spark: SparkSession, path: str) -> DataFrame:
    """Buildings under one set of column names; land uses, provinces and cities in English."""
    rows = table(spark, path)
    rows = rows.withColumnsRenamed({c: BUILDING_NAMES[c] for c in rows.columns if c in BUILDING_NAMES})
    known = typed(rows, BUILDING, path)
    return in_english(known.withColumns({"land_use_type": _translated(F.col("land_use_type"), LAND_USES), "province": _translated(F.col("province"), PROVINCES), "city": _translated(F.col("city"), TOWNS)}))


def partitions(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hospitals, residences and all buildings."""
    return rows.filter(F.col("land_use_type") == HEALTHCARE), rows.filter(F.col("land_use_type") == RESIDENTIAL), rows
