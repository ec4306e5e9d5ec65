"""Tables of the media data model, mapped from the star-schema tables that the queries are given.

Each mapping is SQL text for Spark, and for DuckDB where the dialects part. `{name}` stands for a
given table or another mapping.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> text for both engines, or (Spark, DuckDB).
MAPPED: dict[str, str | tuple[str, str]] = {
    "files": (
        "SELECT doc_id AS file_id, concat('doc/', doc_id, '.txt') AS path, concat(doc_id, CASE WHEN doc_id % 3 = 0 THEN '.GIF' WHEN doc_id % 3 = 1 THEN '.tag.png' ELSE '.txt' END) AS name, octet_length(text) AS length, encode(text, 'UTF-8') AS content, source, CASE WHEN doc_id % 7 = 0 THEN 'image/gif' ELSE 'text/plain' END AS mime FROM {documents}",
        "SELECT doc_id AS file_id, concat('doc/', doc_id, '.txt') AS path, concat(doc_id, CASE WHEN doc_id % 3 = 0 THEN '.GIF' WHEN doc_id % 3 = 1 THEN '.tag.png' ELSE '.txt' END) AS name, strlen(text)::INT AS length, text, source, CASE WHEN doc_id % 7 = 0 THEN 'image/gif' ELSE 'text/plain' END AS mime FROM {documents}",
    ),
    "chunks": (
        "SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS chunk_no, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'acTL' WHEN l_returnflag = 'N' THEN 'IDAT' WHEN l_returnflag = 'R' THEN 'fcTL' ELSE 'fdAT' END AS type, CAST(l_quantity AS BIGINT) AS length, l_partkey % 5 AS keyword_no, l_suppkey AS tag_no FROM {lineitem}"
    ),
    "marked_chunks": (
        # Some acTL chunks become tEXt with a marker, valid or not.
        "SELECT path, chunk_no, CASE WHEN type = 'acTL' AND keyword_no = 0 THEN 'tEXt' ELSE type END AS type, length, CASE WHEN type = 'acTL' AND keyword_no = 0 THEN 'disguise' END AS keyword, CASE WHEN type = 'acTL' AND keyword_no = 0 THEN CASE WHEN tag_no % 3 = 0 THEN concat(tag_no, ';STATIC;1') WHEN tag_no % 3 = 1 THEN concat('1;ANIMATED;', length) WHEN length % 2 = 0 THEN concat('v', length, ';ANIMATED;many') ELSE 'broken;x' END END AS value FROM {chunks}"
    ),
    "frames": (
        "SELECT path, sum(1) OVER (PARTITION BY path ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS frame_no, CAST(1 + length % 4 AS INT) AS w, CAST(1 + tag_no % 3 AS INT) AS h, CAST(length % 9 AS INT) AS delay_num, CAST(tag_no % 4 * 50 AS INT) AS delay_den, keyword_no > 0 AS has_ctl FROM {chunks} WHERE type = 'fcTL'"
    ),
    "text_chunks": (
        "SELECT concat('conv/', conv_id) AS path, turn AS chunk_no, CASE WHEN conv_id % 5 = 0 THEN concat(role, ' prompt!') ELSE role END AS keyword, text AS value FROM {conversations}"
    ),
    "tags": (
        "SELECT c_custkey AS path, name, CASE WHEN c_nationkey % 2 = 0 THEN 'S' ELSE 'W' END AS value, v AS nums FROM (SELECT c_custkey, c_nationkey, c_acctbal, explode(map('GPSLatitude', array(floor(abs(c_acctbal) / 60), floor(abs(c_acctbal)) % 60, 30.5D), 'GPSLongitude', array(floor(abs(c_acctbal) / 50), floor(abs(c_acctbal)) % 60, 12.25D), 'OwnerName', array(1D), 'LensModel', array(2D), 'GPSTimeStamp', array(3D))) AS (name, v) FROM {customer})",
        "SELECT c_custkey AS path, name, CASE WHEN c_nationkey % 2 = 0 THEN 'S' ELSE 'W' END AS value, v AS nums FROM (SELECT c_custkey, c_nationkey, unnest(['GPSLatitude', 'GPSLongitude', 'OwnerName', 'LensModel', 'GPSTimeStamp']) AS name, unnest([[floor(abs(c_acctbal) / 60), floor(abs(c_acctbal)) % 60, 30.5], [floor(abs(c_acctbal) / 50), floor(abs(c_acctbal)) % 60, 12.25], [1.0::DOUBLE], [2.0::DOUBLE], [3.0::DOUBLE]]) AS v FROM {customer})",
    ),
    "presets": (
        "SELECT doc_id AS id, concat(CASE doc_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '' END, substring(md5(text), 2, CAST(4 - doc_id % 3 AS INT))) AS str FROM {documents}"
    ),
    "exposures": (
        "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 40 AS t, 1 + CAST(p_size AS DOUBLE) / 10 AS f, CASE p_partkey % 4 WHEN 0 THEN 6.06D WHEN 1 THEN 2.3D ELSE CAST(p_size AS DOUBLE) / 3 END AS focal, CASE p_partkey % 5 WHEN 0 THEN concat('1/', p_size) WHEN 1 THEN concat(p_size, '.5') WHEN 2 THEN '-3' WHEN 3 THEN concat(p_size, '/0') ELSE 'auto' END AS raw, p_retailprice / 10 - 100 AS lat, p_retailprice / 5 - 200 AS lon FROM {part}",
        "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 40 AS t, 1 + CAST(p_size AS DOUBLE) / 10 AS f, CASE p_partkey % 4 WHEN 0 THEN 6.06::DOUBLE WHEN 1 THEN 2.3::DOUBLE ELSE CAST(p_size AS DOUBLE) / 3 END AS focal, CASE p_partkey % 5 WHEN 0 THEN concat('1/', p_size) WHEN 1 THEN concat(p_size, '.5') WHEN 2 THEN '-3' WHEN 3 THEN concat(p_size, '/0') ELSE 'auto' END AS raw, p_retailprice / 10 - 100 AS lat, p_retailprice / 5 - 200 AS lon FROM {part}",
    ),
    "pixels": (
        "SELECT image_id, x, y, r, CAST((r * 3 + x * 17 + y * 5) % 256 AS INT) AS g, CAST((r * 7 + y * 31 + x) % 256 AS INT) AS b, CAST((r * 5 + x * y * 3 + image_id) % 256 AS INT) AS a FROM (SELECT vec_id AS image_id, CAST(i % 8 AS INT) AS x, CAST(i div 8 AS INT) AS y, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5D) AS INT) AS r FROM (SELECT vec_id, posexplode(embedding) AS (i, e) FROM {embeddings}))",
        "SELECT image_id, x, y, r, CAST((r * 3 + x * 17 + y * 5) % 256 AS INT) AS g, CAST((r * 7 + y * 31 + x) % 256 AS INT) AS b, CAST((r * 5 + x * y * 3 + image_id) % 256 AS INT) AS a FROM (SELECT vec_id AS image_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INT) AS r FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM {embeddings}))",
    ),
    "items": (
        "SELECT path AS group_id, chunk_no AS pos, CAST(length AS INT) AS w, CAST(tag_no % 97 + 1 AS INT) AS h FROM {chunks}"
    ),
    "history": (
        "SELECT event_id AS id, event_type AS type, concat(event_type, event_id, '.png') AS filename, CAST(floor(value * 100) AS BIGINT) AS size, ts AS time, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS dedupe_key FROM {events}"
    ),
    "probes": (
        "SELECT l_partkey AS file_id, round(1 - l_discount, 2) AS scale, round(1 - l_tax * 10, 2) AS quality, CAST(floor(l_extendedprice) AS BIGINT) AS size FROM {lineitem}"
    ),
    "results": (
        "SELECT o_orderkey AS id, o_orderstatus = 'F' AS failed, CAST(floor(o_totalprice) AS BIGINT) AS old_size, CAST(floor(o_totalprice * (o_custkey % 13) / 10) AS BIGINT) AS new_size, o_custkey % 7 AS batch_id FROM {orders}"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or mapped table."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = MAPPED[name] if isinstance(MAPPED[name], str) else MAPPED[name][0]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{([a-z_]+)\}", text))})


def duck(query: str) -> str:
    """A query for DuckDB: `{name}` becomes the given table or the mapping's text."""
    def one(m: re.Match) -> str:
        if m[1] in GIVEN:
            return m[1]
        text = MAPPED[m[1]] if isinstance(MAPPED[m[1]], str) else MAPPED[m[1]][1]
        return f"({duck(text)})"

    return re.sub(r"\{([a-z_]+)\}", one, query)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files")
