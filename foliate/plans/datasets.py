"""Linkage inputs derived from the driver's tables by SQL that Spark and DuckDB both run.

Each text names its tables in braces.  Values vary by the key's remainders, so that every
branch of parsing, scoring and conflict detection occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.sources.tables import spread

#: A line's place in its order, as the text of members has it.
PLACE = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT)"

TEXTS = {
    "lib_files": """
SELECT p_partkey AS file_id, concat('/lib/', CASE WHEN p_partkey % 8 = 7 THEN 'misc' ELSE concat(p_name, ' (', CAST(1940 + p_partkey % 80 AS STRING), ')') END, '/',
  CASE p_partkey % 8
    WHEN 0 THEN concat(p_name, ' #', lpad(CAST(p_size AS STRING), 3, '0'), ' (', CAST(1940 + p_partkey % 80 AS STRING), ').cbz')
    WHEN 1 THEN concat(p_name, ' #0', CAST(p_size AS STRING), 'A.cbz')
    WHEN 2 THEN concat(p_name, ' Annual #', CAST(p_size AS STRING), '.cbz')
    WHEN 3 THEN concat(p_name, ' Special ', CAST(p_size AS STRING), ' v2.cbz')
    WHEN 4 THEN concat('The ', p_name, ' TPB vol 1 (', CAST(1940 + p_partkey % 80 AS STRING), ').cbz')
    WHEN 5 THEN concat(p_name, '_', lpad(CAST(p_size AS STRING), 3, '0'), '.cbr')
    WHEN 6 THEN concat(p_name, ' issue ', CAST(p_size AS STRING), '.5 - End.cbz')
    ELSE concat(p_name, ' (', CAST(1940 + p_partkey % 80 AS STRING), ') One-Shot.CBZ') END) AS path
FROM {part}""",
    "candidates": """
SELECT p_partkey AS file_id, 1 AS pool_pos, 'Filename' AS provider, '' AS issue_id, '' AS series_id, p_name AS series_name,
  CAST(p_size AS STRING) AS issue_number, CAST(1940 + p_partkey % 80 AS INT) AS publication_year, '' AS publisher, '' AS volume
FROM {part} WHERE p_partkey % 5 <> 4
UNION ALL
SELECT p_partkey, 2, 'Kapowarr', CASE WHEN p_partkey % 2 = 0 THEN concat('4000-', CAST(p_partkey AS STRING)) ELSE '' END, concat('4050-', CAST(p_size AS STRING)),
  CASE p_partkey % 7 WHEN 0 THEN concat('The ', p_name) WHEN 1 THEN concat(p_name, ' Beyond') WHEN 2 THEN concat('Other ', p_name) WHEN 3 THEN concat(p_name, ' Omnibus') ELSE p_name END,
  CASE p_partkey % 11 WHEN 0 THEN CAST(p_size + 1 AS STRING) WHEN 1 THEN concat(CAST(p_size AS STRING), 'A') WHEN 2 THEN '' ELSE CAST(p_size AS STRING) END,
  CAST(1940 + p_partkey % 80 + CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 9 ELSE 0 END AS INT),
  p_brand, CASE WHEN p_partkey % 13 = 0 THEN '2' ELSE '' END
FROM {part} WHERE p_partkey % 3 <> 0
UNION ALL
SELECT p_partkey, 3, 'ComicVine', concat('4000-', CAST(p_partkey + p_partkey % 2 AS STRING)), '',
  CASE p_partkey % 9 WHEN 0 THEN concat('A ', p_name) WHEN 1 THEN concat('New ', p_name) WHEN 2 THEN concat(p_name, '!') ELSE p_name END,
  CASE p_partkey % 10 WHEN 0 THEN concat('0', CAST(p_size AS STRING)) WHEN 1 THEN CAST(p_size + 2 AS STRING) ELSE CAST(p_size AS STRING) END,
  CAST(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1940 + p_partkey % 80 + CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 0 END END AS INT),
  '', CASE WHEN p_partkey % 17 = 0 THEN '1' ELSE '' END
FROM {part} WHERE p_partkey % 19 <> 0
UNION ALL
SELECT p_partkey, 4, 'GCD', '', CASE WHEN p_partkey % 2 = 0 THEN concat('s', CAST(p_size AS STRING)) ELSE '' END, p_name, CAST(p_size AS STRING),
  CAST(1940 + p_partkey % 80 AS INT), p_brand, ''
FROM {part} WHERE p_partkey % 4 = 0""",
    "existing": """
SELECT p_partkey AS file_id, CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' Extra') WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS series,
  p_type AS title, CASE WHEN p_partkey % 20 = 0 THEN '' WHEN p_partkey % 15 = 0 THEN '99' ELSE CAST(p_size AS STRING) END AS number,
  CAST(1940 + p_partkey % 80 + CASE WHEN p_partkey % 25 = 0 THEN 4 ELSE 0 END AS INT) AS year, '' AS publisher, '' AS volume,
  CASE WHEN p_partkey % 10 = 0 THEN concat('4000-', CAST(p_partkey + p_partkey % 4 AS STRING)) ELSE '' END AS provider_id,
  CASE WHEN p_partkey % 10 = 5 THEN concat('https://comicvine.gamespot.com/x/4000-', CAST(p_partkey AS STRING), '/') ELSE '' END AS web
FROM {part} WHERE p_partkey % 5 = 0""",
    "numbers": """
SELECT p_partkey AS id, CASE p_partkey % 16 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat('00', CAST(p_size AS STRING)) WHEN 2 THEN concat(CAST(p_size AS STRING), 'a')
  WHEN 3 THEN concat(CAST(p_size AS STRING), '.5') WHEN 4 THEN concat('Annual #', CAST(p_size AS STRING)) WHEN 5 THEN 'Special' WHEN 6 THEN '1/2' WHEN 7 THEN ''
  WHEN 8 THEN concat('TPB ', CAST(p_size AS STRING)) WHEN 9 THEN 'FCBD' WHEN 10 THEN concat(CAST(p_size AS STRING), ' variant') WHEN 11 THEN 'x'
  WHEN 12 THEN concat(CAST(p_size AS STRING), 'B') WHEN 13 THEN 'annual' WHEN 14 THEN concat(' ', CAST(p_size AS STRING), ' ') ELSE '0' END AS raw
FROM {part}""",
    "members": """
SELECT l_orderkey AS collection_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN 'Second' ELSE 'Series!' END AS series_name,
  CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Acme' ELSE CASE WHEN l_orderkey % 4 = 0 THEN ' acme' ELSE 'ACME' END END AS publisher,
  CASE WHEN l_orderkey % 7 = 0 THEN concat('v', CAST(l_suppkey % 2 AS STRING)) ELSE '' END AS volume_id,
  CASE WHEN l_partkey % 10 = 0 THEN concat(CAST(l_partkey % 6 AS STRING), 'A') WHEN l_partkey % 23 = 0 THEN 'Annual' ELSE CAST(l_partkey % 6 AS STRING) END AS issue_number,
  CASE WHEN l_quantity > 40 THEN '' ELSE concat('T', CAST(l_linenumber AS STRING)) END AS title,
  CAST(CASE WHEN l_linestatus = 'O' THEN year(l_shipdate) ELSE 0 END AS INT) AS year, CAST(CASE WHEN l_tax > 0.04 THEN month(l_shipdate) ELSE 0 END AS INT) AS month,
  CAST(CASE WHEN l_tax > 0.06 THEN day(l_shipdate) ELSE 0 END AS INT) AS day,
  CASE WHEN l_discount > 0.03 THEN concat('http://u/', CAST(l_partkey AS STRING)) ELSE '' END AS web,
  CASE WHEN l_discount > 0.05 THEN concat('sum ', l_returnflag) ELSE '' END AS summary, CASE WHEN l_discount > 0.08 THEN l_returnflag ELSE '' END AS notes,
  CASE WHEN l_tax > 0.05 THEN concat('id', CAST(l_partkey AS STRING)) ELSE '' END AS provider_id,
  concat('Writer ', CAST(l_suppkey % 4 AS STRING), ';', CASE WHEN l_suppkey % 2 = 0 THEN ' writer 1' ELSE 'Writer 0' END, ';') AS writers,
  concat('Pen ', CAST(l_suppkey % 3 AS STRING), ';pen 1') AS pencillers, CASE WHEN l_linenumber = 1 THEN 'Ink' ELSE '' END AS inkers, '' AS colorists, concat('L', CAST(l_linenumber % 2 AS STRING)) AS letterers, '' AS cover_artists,
  concat('Hero ', CAST(l_partkey % 5 AS STRING), '; hero 2 ;;Hero 2') AS characters, concat('Team ', CAST(l_linenumber % 2 AS STRING)) AS teams, CASE WHEN l_partkey % 4 = 0 THEN 'Arc A;arc a' ELSE '' END AS story_arcs,
  CAST(l_linenumber AS STRING) AS story_arc_numbers, CASE WHEN l_suppkey % 2 = 0 THEN 'Action' ELSE '' END AS genre, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'fr' END AS language
FROM {lineitem}""",
    "jobs": """
SELECT event_id, user_id AS job_id, ts, event_type, value,
  CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' WHEN 'login' THEN 'SKIPPED' WHEN 'logout' THEN 'COMPLETED' WHEN 'click' THEN 'REVIEW' ELSE 'UNRESOLVED' END AS status
FROM {events}""",
    "cache_rows": """
SELECT CASE o_orderkey % 2 WHEN 0 THEN 'Kapowarr' ELSE 'ComicVine' END AS provider, CASE o_orderkey % 4 WHEN 0 THEN 'issue' WHEN 1 THEN 'series' WHEN 2 THEN 'search' ELSE 'url' END AS kind,
  concat('c', CAST(o_custkey AS STRING)) AS cache_key, concat('[', chr(123), CASE WHEN o_orderkey % 5 = 0 THEN '"title":"' ELSE '"series_name":"' END, o_orderpriority, '"', chr(125), ']') AS data_json, CAST(o_orderkey AS BIGINT) AS updated_at,
  CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1000 + o_orderkey % 500 END AS expires_at, CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '2' END AS schema_version
FROM {orders}""",
    "reading": """
SELECT p_partkey AS line_id, CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' #', CAST(p_size AS STRING), '-', CAST(p_size + 3 AS STRING)) WHEN 1 THEN concat(p_name, ' issues ', CAST(p_size AS STRING), ' - ', CAST(p_size - 2 AS STRING))
  WHEN 2 THEN concat(p_name, ' #', CAST(p_size AS STRING), 'A') WHEN 3 THEN p_name WHEN 4 THEN concat(p_name, ', #', CAST(p_size AS STRING)) ELSE concat(p_name, ' 2 Special #1') END AS line
FROM {part}""",
    "arcs": """
SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat('"Dark Age", ', c_mktsegment, ', dark (age)') WHEN 1 THEN '' WHEN 2 THEN concat(c_mktsegment, ', ', c_mktsegment, ' War')
  WHEN 3 THEN concat(' ', c_mktsegment, ' ,, X') ELSE 'Night: One, night one, Two' END AS arcs,
  CASE c_custkey % 3 WHEN 0 THEN '4, 5' WHEN 1 THEN '' ELSE '7,, 8 , 9, 10' END AS nums, c_custkey % 40 + 1 AS pos
FROM {customer}""",
    "urls": """
SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat('https://comicvine.gamespot.com/', replace(p_name, ' ', '-'), '/4050-', CAST(p_size AS STRING), '/')
  WHEN 1 THEN concat('https://comicvine.gamespot.com/x/4000-', CAST(p_partkey AS STRING), '/') WHEN 2 THEN concat('https://www.comics.org/issue/', CAST(p_partkey AS STRING), '/')
  WHEN 3 THEN concat('https://www.comics.org/series/', CAST(p_size AS STRING)) WHEN 4 THEN concat('http://kap.local/api?api_key=', p_brand, '&q=', CAST(p_size AS STRING))
  WHEN 5 THEN 'Script: A Person' WHEN 6 THEN concat('https://comicvine.gamespot.com/volume/4050-', CAST(p_size AS STRING)) ELSE concat('ftp://x/', p_name) END AS url,
  CASE p_partkey % 7 WHEN 0 THEN concat(CAST(1950 + p_size AS STRING), '-03-', CAST(p_size % 28 + 1 AS STRING)) WHEN 1 THEN concat('March ', CAST(p_size % 28 + 1 AS STRING), ', ', CAST(1950 + p_size AS STRING))
  WHEN 2 THEN concat('Sep ', CAST(1950 + p_size AS STRING)) WHEN 3 THEN CAST(1950 + p_size AS STRING) WHEN 4 THEN concat('Smarch ', CAST(p_size % 28 + 1 AS STRING), ', 1999') WHEN 5 THEN '' ELSE 'soon' END AS day_text,
  CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, ' (as ', p_type, ')') WHEN 1 THEN concat(p_brand, ' ?') WHEN 2 THEN concat(p_brand, ' (unclosed') ELSE p_brand END AS creator
FROM {part}""",
    "catalog_json": """
SELECT p_partkey AS row_id, concat(chr(123), '"id":', CAST(p_partkey % 50 AS STRING), ',"title":"', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, '","name":"', p_brand, '","year":"', CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE CAST(1950 + p_size AS STRING) END,
  '","issues":[', chr(123), '"id":', CAST(p_partkey * 2 AS STRING), ',"issue_number":"#', CAST(p_size AS STRING), '","date":"', CASE WHEN p_partkey % 5 = 0 THEN '2001-05-01' ELSE '' END, '"', chr(125), ',', chr(123), '"id":', CAST(p_partkey % 500 + 10000000 AS STRING), ',"number":"', CAST(p_size + 1 AS STRING), '","title":"T"', chr(125), ']', chr(125)) AS data
FROM {part}""",
    "manifest": """
SELECT l_orderkey AS archive, concat('Page', CAST(l_linenumber AS STRING), '.JPG') AS entry, CAST(l_partkey AS BIGINT) AS crc, CAST(l_quantity AS BIGINT) AS size, CAST(l_suppkey AS STRING) AS sha256
FROM {lineitem}
UNION ALL SELECT o_orderkey, 'ComicInfo.xml', 1, 1, 'x' FROM {orders}""",
    "manifest_new": """
SELECT l_orderkey AS archive, concat(CASE WHEN l_partkey % 60 = 2 THEN 'moved' ELSE 'page' END, CAST(l_linenumber AS STRING), '.jpg') AS entry, CAST(l_partkey + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS BIGINT) AS crc, CAST(l_quantity AS BIGINT) AS size,
  CASE WHEN l_partkey % 70 = 1 THEN 'changed' ELSE CAST(l_suppkey AS STRING) END AS sha256
FROM {lineitem}
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 0 THEN 'extra.txt' ELSE 'comicinfo.XML' END, 1, 1, 'y' FROM {orders}""",
    "related_issues": """
SELECT p_partkey AS row_id, concat(chr(123), '"id":', CAST(p_partkey AS STRING), ',"number":"#', CAST(p_size AS STRING), '","title":"', CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END, '","publication_date":"', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('May ', CAST(1940 + p_partkey % 80 AS STRING)) END,
  '","series_id":', CAST(CASE WHEN p_partkey % 10 = 0 THEN -1 ELSE p_partkey - p_partkey % 7 END AS STRING), ',"story_set":[', chr(123), '"writer":"', p_brand, '; ', p_type, ' (plot)","characters":"', p_name, '"', chr(125), ',', chr(123), '"writer":"', p_type, ', Ann?","inker":"', p_brand, '"', chr(125), ']', chr(125)) AS data
FROM {part}""",
    "related_series": """
SELECT p_partkey AS row_id, concat(chr(123), '"id":', CAST(p_partkey AS STRING), ',"name":"', p_name, '","publisher_id":', CAST(p_partkey % 150 AS STRING), chr(125)) AS data FROM {part}""",
    "related_publishers": """
SELECT s_suppkey AS row_id, concat(chr(123), '"id":', CAST(s_suppkey AS STRING), ',"name":"', s_name, '"', chr(125)) AS data FROM {supplier}""",
    "volume_pages": """
SELECT p_partkey % 40 AS volume_id, CAST(floor(p_partkey / 40) + 1 AS INT) AS page_no, 'red-sky' AS slug,
  concat('<h1>Red Sky</h1><ul><li>#', CAST(p_size AS STRING), CASE WHEN p_partkey % 6 = 0 THEN 'A' ELSE '' END, ' <a href="/', CASE p_partkey % 5 WHEN 0 THEN 'blue-sky-1' WHEN 1 THEN 'the-red-sky-7' ELSE 'red-sky-annual' END, '/4000-', CAST(p_partkey AS STRING), '/">', p_name,
  '</a></li><li>#1-5 <a href="/red-sky-2/4000-', CAST(p_partkey + 10000000 AS STRING), '/">all</a></li><li><a href="/red-sky/4000-', CAST(p_partkey + 20000000 AS STRING), '/">Issue ', CAST(p_size + 100 AS STRING), '</a></li></ul>') AS html
FROM {part}""",
    "order_pages": """
SELECT p_partkey AS page_id, concat('<p><a href="/x/4000-', CAST(p_partkey AS STRING), '/">', p_name, ' #', CAST(p_size AS STRING), CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END, '</a> <a href="/x/4000-1/">Edit page</a> <a href="/x/4005-1/">Who #3</a> <a href="/x/4000-', CAST(p_partkey + 1 AS STRING), '/">', p_type, '</a>',
  '<a href="/x/4000-', CAST(p_partkey AS STRING), '/">again #9</a></p>') AS html
FROM {part}""",
    "known_files": """
SELECT concat('/lib/', CAST(o_custkey AS STRING)) AS path, CAST(o_orderkey % 97 AS BIGINT) AS size, CAST(o_orderkey % 89 AS BIGINT) AS mtime, concat('h', CAST(o_orderkey % 83 AS STRING)) AS sha256, o_orderstatus AS status, CAST(o_orderkey AS BIGINT) AS updated_at
FROM {orders}""",
    "seen_files": """
SELECT concat('/lib/', CAST(o_custkey AS STRING)) AS path, CAST(o_orderkey % 97 AS BIGINT) AS size, CAST(o_orderkey % 89 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS mtime,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('h', CAST(o_orderkey % 83 AS STRING)) END AS sha256, CAST(o_orderkey AS BIGINT) AS seen_id
FROM {orders}""",
    "leases": """
SELECT o_orderkey AS job_id, concat('/lib/', CAST(o_custkey AS STRING)) AS path, CASE o_orderkey % 5 WHEN 0 THEN '' ELSE concat('h', CAST(o_orderkey % 83 AS STRING)) END AS sha256,
  CASE o_orderkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'RETRYING' WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'FAILED' ELSE 'REVIEW' END AS status,
  CAST(o_orderkey % 4 AS INT) AS attempts, 3 AS max_attempts, CAST(o_orderkey % 1000 AS BIGINT) AS lease_until, CAST(o_orderkey % 777 AS BIGINT) AS created_at
FROM {orders}""",
    "calls": """
SELECT l_orderkey * 10 + l_linenumber AS call_id, CASE l_suppkey % 3 WHEN 0 THEN 'kap' WHEN 1 THEN 'Comic_Vine' ELSE 'gcd' END AS provider,
  CASE l_linenumber WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 401 WHEN 6 THEN 422 ELSE 418 END AS http_status,
  l_quantity AS ms, CASE WHEN l_returnflag = 'R' THEN TRUE ELSE FALSE END AS cache_hit, CASE WHEN l_returnflag = 'A' THEN FALSE ELSE TRUE END AS cache_lookup
FROM {lineitem}""",
    "issue_pages": """
SELECT p_partkey AS page_id, concat('<html><head><title>T</title>',
  CASE WHEN p_partkey % 4 = 1 THEN concat('<meta property="og:title" content="', p_name, ' #', CAST(p_size AS STRING), ' - Tale of ', p_type, ' (Issue)">') ELSE '' END,
  CASE WHEN p_partkey % 3 = 1 THEN '<meta name="adtags" content="a=1&amp;publisher=red-star&amp;b=2">' ELSE '' END,
  '<meta name="description" content="About ', p_name, '"></head><body><h1>',
  CASE WHEN p_partkey % 3 = 0 THEN concat('<a class="wiki-title" href="/v/4050-1/">', p_name, '</a> <a class="wiki-issue-number">#', CAST(p_size AS STRING), '</a>')
    ELSE concat(p_name, ' #', CAST(p_size AS STRING), CASE WHEN p_partkey % 4 = 2 THEN concat(' - Part ', p_type) ELSE '' END) END,
  '</h1><p class="wiki-descriptor">An issue', CASE WHEN p_partkey % 3 = 0 THEN ' released by Blue Moon on March 5, 1999' ELSE '' END,
  '</p><div>Issue details <b>Name</b> ', CASE WHEN p_partkey % 4 = 0 THEN concat('Deep ', p_type) ELSE 'None' END, ' Name <br><i>Name of this issue</i></div>',
  CASE p_partkey % 5 WHEN 0 THEN concat('<div>In Store Date May ', CAST(p_size % 28 + 1 AS STRING), ', ', CAST(1950 + p_size AS STRING), '</div>') WHEN 1 THEN concat('<div>Cover Date June ', CAST(1950 + p_size AS STRING), '</div>') ELSE '' END,
  CASE WHEN p_partkey % 2 = 0 THEN concat('<div class="js-toc-content">Part 1 last edited by bob on 01/02/20 10:00 View full history The <b>story</b> of ', p_type, '<span class="wiki-item-edit">edit <a href="/e/">Edit</a></span></div>') ELSE '' END,
  '<div class="wiki-details-object"><h3>Creators</h3><ul><li><a href="/p/1/">Ann ', CAST(p_size AS STRING), '</a> <span>Writer, artist</span></li><li><span>artist, cover</span> <a href="/p/2/">Bob</a></li><li><a href="/p/1/">Ann ', CAST(p_size AS STRING), '</a> writer, penciler</li></ul></div>',
  '<div class="wiki-details-object"><h3>Characters</h3><a>None</a><a href="/c/1/">Moss ', CAST(p_size AS STRING), '</a><a href="/c/2/">Fern</a><a href="/c/1/">Moss ', CAST(p_size AS STRING), '</a><a>x</a></div>',
  CASE WHEN p_partkey % 7 = 0 THEN '<div class="wiki-details-object"><h3>Teams</h3><a href="/t/1/">The Six</a><a>Add</a></div><div class="wiki-details-object"><h3>Story Arcs</h3><a href="/a/1/">"Dark Age"</a></div>' ELSE '' END, '</body></html>') AS html
FROM {part}""",
    "series_pages": """
SELECT p_partkey AS page_id, concat(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('<h1>', p_name, ' <i>', CAST(1950 + p_size AS STRING), '</i></h1>') END, '<table><tr><th>none</th></tr><tr><td><a href="/series/', CAST(p_partkey AS STRING), '/">', p_name, ' <b>', p_type, '</b></a></td><td>', CAST(1950 + p_size AS STRING), '</td><td> ', CAST(p_size AS STRING), ' Issues ', repeat(concat(p_brand, ' '), 20),
  '</td><td><a href="/series/9/">late</a></td></tr><tr><td><a href="https://www.comics.org/series/', CAST(p_partkey AS STRING), '/">again</a></td></tr><tr><td>in 2001 <a href="/issue/', CAST(p_partkey AS STRING), '/">#00', CAST(p_size AS STRING), '<b>b</b></a></td></tr><tr><td><a href="/issue/', CAST(p_partkey + 10000000 AS STRING), '/">#', CAST(p_size AS STRING), 'b</a> <a href="/issue/8/">No. 000</a></td></tr></table>',
  '<a href="/x/4045-', CAST(p_partkey AS STRING), '/">Dark', CASE WHEN p_partkey % 3 = 0 THEN '</a>' ELSE ' Age</a>' END, '<a href="https://v.example/y/4045-', CAST(p_size AS STRING), '/">ab</a><a href="https://v.example/y/4045-', CAST(p_size AS STRING), '/">late name</a>') AS html
FROM {part}""",
    "series_json": """
SELECT p_partkey AS row_id, concat(chr(123), '"id":', CAST(p_partkey AS STRING), ',"name":"', p_name, '","active_issues":["https://c.example/api/issue/', CAST(p_partkey AS STRING), '/?f","bad","https://c.example/api/issue/', CAST(p_partkey + 7 AS STRING), '/","https://c.example/api/issue/', CAST(p_partkey + 90000000 AS STRING), '/"]', chr(125)) AS data FROM {part}""",
    "pasted_pages": """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 9 = 0 THEN concat('<html><head><title>', CASE WHEN p_partkey % 2 = 0 THEN concat('GCD :: Issue :: ', p_name, ' #', CAST(p_size AS STRING)) ELSE 'GCD' END, '</title></head><body><h1>', p_name, '</h1><p>Far Moon Press, 19', CAST(p_partkey % 90 + 10 AS STRING), ' Series</p><p>Script: No One</p></body></html>')
  ELSE concat(CASE WHEN p_partkey % 5 = 0 THEN concat('https://catalog.example/issue/', CAST(p_partkey AS STRING), '/', chr(10), ' http://second.example/', chr(10)) ELSE '' END, '  ', p_name,
    CASE p_partkey % 6 WHEN 0 THEN concat(' #', CAST(p_size AS STRING), 'b') WHEN 1 THEN concat(' ', CAST(p_size AS STRING)) WHEN 2 THEN ' [nn] 7' WHEN 3 THEN concat(' #', CAST(p_size AS STRING), '.5') ELSE '' END, ' ', chr(13), chr(10), chr(10),
    CASE p_partkey % 4 WHEN 0 THEN concat('by ', p_brand, ', Moon Press, 1999 Series', chr(10)) WHEN 1 THEN concat('Dark House', chr(10), 'Red Star, ', CAST(1950 + p_size AS STRING), '  Series', chr(10)) ELSE '' END,
    CASE p_partkey % 7 WHEN 0 THEN 'march 2001' WHEN 1 THEN 'Summer 1988' WHEN 2 THEN 'Marching 1977' ELSE 'On sale: May 2003' END, chr(10),
    'Writer: Ann (plot); Bob?, none,', p_brand, ' (script', chr(10), 'Script: Ann; Cid ', CAST(p_size AS STRING), chr(10), 'Penciller: None', chr(10), 'Pencils: Dee, Dee; Eve (pages 1-2) Fox', chr(10), 'Inks:', chr(10), 'Inker: Dee', chr(10), 'Colorist: ?Gus?', chr(10), 'Letters: Hal;;Ida', chr(10),
    'Genre: humor', chr(10), 'Genre: ', p_type, '; war', chr(10), 'Characters: A; Moss, Fern; none; Moss, Fern; Vale (cameo)', chr(10), 'Editing: Jo') END AS text
FROM {part}""",
    "search_pages": """
SELECT p_partkey AS page_id, concat('<ul><li><a href="/x/4050-', CAST(p_partkey AS STRING), '/">', p_name, '</a> (', CAST(1950 + p_size AS STRING), ') (', CAST(p_size AS STRING), ' issues) ', repeat(concat(p_type, ' '), 12), '</li><li>of 2001 <a href="/y/4000-', CAST(p_partkey AS STRING),
  '/">', p_type, '</a></li><li><a href="/x/4050-', CAST(p_partkey AS STRING), '/">again</a></li><li><a href="/z/">other</a></li></ul>') AS html
FROM {part}""",
    "xml_records": """
SELECT p_partkey AS file_id, concat('<ComicInfo><Title>', p_type, '</Title><Series>', p_name, '</Series><Number>', CAST(p_size AS STRING), '</Number><Summary></Summary><Year>', CASE WHEN p_partkey % 6 = 0 THEN 'soon' ELSE CAST(1940 + p_partkey % 80 AS STRING) END,
  '</Year><Month>', CAST(p_partkey % 12 + 1 AS STRING), '</Month><Day>', CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE '3' END, '</Day>', CASE p_partkey % 5 WHEN 0 THEN '<Count>many</Count>' WHEN 1 THEN '' ELSE '<Count>12</Count>' END,
  '<Writer>Ann; Bob ', CAST(p_size AS STRING), ';</Writer><Characters>A, B; C</Characters><StoryArc>Dark Age, ', p_name, '</StoryArc><StoryArc>Night</StoryArc><StoryArcNumber>1,, 2</StoryArcNumber>',
  CASE WHEN p_partkey % 4 = 0 THEN concat('<BlackAndWhite>Yes</BlackAndWhite><Score note="1">', CAST(p_size AS STRING), ' &lt; 60</Score><Empty></Empty>') ELSE '' END, CASE WHEN p_partkey % 11 = 0 THEN '<Bad' ELSE '' END, '</ComicInfo>') AS record
FROM {part}""",
    "vendor_rows": """
SELECT p_partkey AS item, p_name AS label, CAST(p_size AS STRING) AS issue_no, CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE CAST(1940 + p_partkey % 80 AS STRING) END AS yr, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('v', CAST(p_partkey AS STRING)) END AS code
FROM {part}""",
    "folders": """
SELECT p_partkey AS folder_id, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('/Volume ', CAST(p_size AS STRING)) ELSE concat('/', CAST(1940 + p_size AS STRING), '/extra') END) AS rel_path
FROM {part}""",
    "overrides": """
SELECT p_partkey AS file_id, concat('https://comicvine.gamespot.com/x/4000-', CAST(p_partkey AS STRING), '/') AS url, concat('4000-', CAST(p_partkey AS STRING)) AS issue_id, p_name AS series_name, CAST(p_size AS STRING) AS issue_number, CAST(1940 + p_partkey % 80 AS INT) AS year
FROM {part} WHERE p_partkey % 41 = 0""",
    "cached": """
SELECT p_partkey AS file_id, 1 AS pool_pos, CASE WHEN p_partkey % 2 = 0 THEN 'Kapowarr' ELSE 'ComicVine' END AS provider, concat('4000-', CAST(p_partkey AS STRING)) AS issue_id, '' AS series_id, p_name AS series_name,
  CASE WHEN p_partkey % 46 = 0 THEN CAST(p_size + 5 AS STRING) ELSE CAST(p_size AS STRING) END AS issue_number, CAST(1940 + p_partkey % 80 AS INT) AS publication_year, '' AS publisher, '' AS volume
FROM {part} WHERE p_partkey % 23 = 0""",
    "url_requests": """
SELECT o_orderkey AS request_id, concat(CASE o_orderkey % 4 WHEN 0 THEN '[' ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN '"' ELSE '' END, 'https://comicvine.gamespot.com/x/4000-', CAST(o_custkey * 2 AS STRING), '/', CASE WHEN o_orderkey % 4 = 0 THEN '", "' ELSE ', ' END,
  'https://comicvine.gamespot.com/y/4000-', CAST(o_custkey * 2 + 4 AS STRING), '/', CASE o_orderkey % 4 WHEN 0 THEN '"]' WHEN 1 THEN ' http://www.comics.org/issue/5/' ELSE '' END) AS urls
FROM {orders}""",
}


#: Tables of few bytes a row, from which pages, names and records are made, with their keys.
SMALL = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; small ones are spread over all cores by their key.

    Files of a few MB are read as one split, so that one task would do all that is made of
    their rows: a million rows of part are 4 MB, their pages over 1 GB.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in SMALL:
        return rows
    # inline keeps filters on what is made of the rows above the exchange; pushed below it, the
    # one task that reads the file would make and test all pages, and uses would not share it
    return spread(rows, SMALL[name]).select(F.inline(F.array(F.struct(*rows.columns))))


def derive(spark: SparkSession, sf_dir: str, name: str, shared: bool = False) -> DataFrame:
    """A derived table; shared members have all their uses in a query read one exchange."""
    text = TEXTS[name]
    tables = {t: table(spark, sf_dir, t) for t in ("part", "lineitem", "events", "orders", "customer", "supplier") if "{" + t + "}" in text}
    if name == "members":
        tables["lineitem"], text = placed(tables["lineitem"], shared), text.replace(PLACE, "_pos")
    return spark.sql(text, **tables)


def placed(lines: DataFrame, shared: bool = False) -> DataFrame:
    """Lines dealt by their order, with their place there as _pos.

    They are dealt and sorted as they are: texts made of a line are several times as wide, and
    are made after that.  What groups or joins by the order needs no other exchange.
    """
    dealt = lines.repartition("l_orderkey")
    if shared:  # inline keeps all columns in the exchange, which else each use would have with its own
        dealt = dealt.select("l_orderkey", F.inline(F.array(F.struct(*[x for x in lines.columns if x != "l_orderkey"]))))
    return dealt.withColumn("_pos", F.expr(PLACE))


def duck(name: str) -> str:
    """The same text for DuckDB, as a common table expression."""
    text = TEXTS[name]
    for t in ("part", "lineitem", "events", "orders", "customer", "supplier"):
        text = text.replace("{" + t + "}", t)
    return f"{name} AS ({text})"
