"""Logical tables over the synthetic ones, as one SQL text for Spark and for DuckDB.

Operators never see this SQL: they take DataFrames. Only the queries that the driver compares are
bound to these tables, which give posts, authors, scores, engagements and so on from events,
documents, customers and embeddings by plain arithmetic on their ids. Every document is the whole text
of one post, the one with its id; the other posts have a sentence made of their numbers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"

#: name -> (tables it reads, SQL). {arr}( ) makes an array; other functions are common to both.
BASE: dict[str, tuple[tuple[str, ...], str]] = {
    "acts": (
        ("events", "documents"),
        """SELECT e.event_id AS e, e.user_id AS u, CAST(e.ts AS TIMESTAMP) AS ts, e.value AS value, e.event_type AS kind,
            CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) AS k, d.doc_id AS doc, d.text AS body, CASE WHEN d.doc_id IS NOT NULL THEN d.lang WHEN e.event_id % 4 = 0 THEN 'sw' ELSE 'en' END AS lang
        FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id""",
    ),
    "posts": (
        ("acts",),
        """SELECT 'x' AS platform, concat('p', CAST(e AS STRING)) AS platform_post_id,
            CASE kind WHEN 'view' THEN 'search' WHEN 'click' THEN 'timeline' WHEN 'purchase' THEN 'replies' WHEN 'error' THEN 'hate_search' ELSE 'hate_timeline' END AS type,
            concat('u', CAST(u AS STRING)) AS author_id, concat('User', CAST(u AS STRING)) AS author_handle,
            concat(CASE WHEN doc IS NOT NULL THEN coalesce(body, '') WHEN e % 3 = 0 THEN concat('Report ', CAST(k AS STRING), ' says that prices in Town', CAST(k % 9 AS STRING), ' rise again this week, they told us and the rest of them')
                WHEN e % 3 = 1 THEN concat('Minister Alpha', CAST(u % 5 AS STRING), ' meets Leader Beta', CAST(k % 7 AS STRING), ' about the long awaited water project today') ELSE concat('Nobody knew what happened to them at market ', CAST(k % 11 AS STRING), ' yesterday, said the traders of slogan', chr(CAST(97 + floor(u / 9) % 26 AS INT))) END, CASE e % 40 WHEN 0 THEN ' madoa doa in Nairobi' WHEN 1 THEN ' they say warudi kwao' WHEN 2 THEN ' fumigate Nairobi' WHEN 3 THEN ' Trump and Congress'
                WHEN 4 THEN ' 41 vs 1 and the Luo' WHEN 5 THEN ' mende http://a.b/c @who #Tag' ELSE '' END) AS text,
            lang, ts AS created_at, ts + INTERVAL '1' HOUR * (e % 7) AS collected_at,
            (e % 5 = 1) AS is_repost, CASE WHEN e % 5 = 1 THEN concat('p', CAST(k AS STRING)) END AS repost_of_id,
            CASE WHEN e % 5 = 2 THEN concat('p', CAST(k + 100 AS STRING)) END AS in_reply_to_id,
            (e % 5 = 3) AS is_quote, CASE WHEN e % 5 = 3 THEN concat('p', CAST(k + 200 AS STRING)) END AS quoted_post_id,
            concat('c', CAST(k % 40 AS STRING)) AS conversation_id,
            CAST(e % 500 AS BIGINT) AS repost_count, CAST((e * 7) % 900 AS BIGINT) AS like_count, CAST(e % 60 AS BIGINT) AS reply_count, CAST(e % 30 AS BIGINT) AS quote_count,
            CASE WHEN e % 6 = 0 THEN CAST(NULL AS {strings}) ELSE {arr}(concat('T', CAST(k % 10 AS STRING)), concat('t', CAST(e % 7 AS STRING))) END AS hashtags,
            CASE WHEN e % 4 = 0 THEN CAST(NULL AS {strings}) ELSE {arr}(concat('https://Ex.com/', CAST(k AS STRING), '/?utm_source=', CAST(e % 3 AS STRING))) END AS urls,
            {arr}(concat('M', CAST(u % 9 AS STRING))) AS mentions
        FROM acts""",
    ),
    "posts_raw": (
        ("posts",),
        """SELECT * FROM posts UNION ALL
        SELECT p.platform, p.platform_post_id, CASE WHEN p.like_count % 2 = 0 THEN 'hate_search' ELSE 'search' END AS type, p.author_id, p.author_handle, p.text, p.lang, p.created_at,
            p.collected_at + INTERVAL '1' DAY AS collected_at, p.is_repost, p.repost_of_id, p.in_reply_to_id, p.is_quote, p.quoted_post_id, p.conversation_id,
            p.repost_count + 10 AS repost_count, p.like_count + 20 AS like_count, p.reply_count, p.quote_count, p.hashtags, p.urls, p.mentions
        FROM posts p WHERE p.repost_count % 3 = 0 UNION ALL
        SELECT p.platform, p.platform_post_id, 'search' AS type, p.author_id, p.author_handle, p.text, p.lang, p.created_at,
            p.collected_at + INTERVAL '2' DAY AS collected_at, p.is_repost, p.repost_of_id, p.in_reply_to_id, p.is_quote, p.quoted_post_id, p.conversation_id,
            p.repost_count + 15 AS repost_count, p.like_count + 35 AS like_count, p.reply_count, p.quote_count, p.hashtags, p.urls, p.mentions
        FROM posts p WHERE p.repost_count % 9 = 0""",
    ),
    "authors_raw": (
        ("customer", "nation"),
        """SELECT 'x' AS platform, concat('u', CAST(c.c_custkey AS STRING)) AS platform_user_id,
            CASE WHEN c.c_custkey % 5 = 0 THEN concat('user', CAST(c.c_custkey AS STRING), '99') ELSE concat('User', CAST(c.c_custkey AS STRING)) END AS handle,
            CASE WHEN c.c_custkey % 7 = 0 THEN '' WHEN c.c_custkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS bio,
            CASE c.c_custkey % 9 WHEN 0 THEN 'Nairobi CBD' WHEN 1 THEN 'Mombasa' WHEN 2 THEN 'Kisumu town' WHEN 3 THEN 'Nyeri' WHEN 4 THEN 'Eldoret' WHEN 5 THEN 'Meru' ELSE n.n_name END AS location,
            CASE WHEN c.c_custkey % 6 = 0 THEN 'https://x/Default_Profile.png' ELSE 'https://x/a.png' END AS profile_image_url,
            CAST(floor(abs(c.c_acctbal)) AS BIGINT) AS followers_count, CAST(c.c_custkey % 300 AS BIGINT) AS following_count,
            CAST(c.c_custkey * 13 % 9000 AS BIGINT) AS tweet_count, CAST(c.c_custkey % 17 AS BIGINT) AS listed_count,
            TIMESTAMP '2022-01-01 00:00:00' + INTERVAL '1' DAY * (c.c_custkey * 31 % 750) AS created_at,
            TIMESTAMP '2024-01-20 00:00:00' + INTERVAL '1' HOUR * (c.c_custkey % 24) AS collected_at
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    ),
    "scores": (
        ("acts",),
        """SELECT concat('p', CAST(e AS STRING)) AS platform_post_id, CASE e * 7 % 9 WHEN 0 THEN 'hate' WHEN 1 THEN 'offensive' ELSE 'neither' END AS label,
            (e * 13 % 100) / 100.0E0 AS p_hate, (e * 13 % 100 >= 88) AS hate_flag, (e % 8 <> 0) AS in_scope, (e % 45 = 0) AS coded_suspect, ts + INTERVAL '1' HOUR AS scored_at,
            CASE WHEN e % 4 = 0 THEN NULL ELSE (e * 3 % 100) / 100.0E0 END AS dehumanisation_score, (e * 5 % 100) / 100.0E0 AS violence_call_score,
            (e * 11 % 100) / 100.0E0 AS othering_score, CASE WHEN e % 6 = 0 THEN NULL ELSE (e * 17 % 100) / 100.0E0 END AS political_criticism_score
        FROM acts""",
    ),
    "sentiment": (
        ("acts",),
        """SELECT concat('p', CAST(e AS STRING)) AS platform_post_id, CASE e % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment, CAST(k % 12 AS INT) - 1 AS topic FROM acts""",
    ),
    "engagements_raw": (
        ("acts",),
        """SELECT 'x' AS platform, concat('p', CAST(k AS STRING)) AS platform_post_id, concat('u', CAST((u * 7 + e) % 150 AS STRING)) AS platform_user_id,
            CASE WHEN e % 3 = 0 THEN 'like' ELSE 'retweet' END AS kind, ts AS collected_at FROM acts WHERE e % 4 = 0""",
    ),
    "trace": (
        ("lineitem",),
        """SELECT DISTINCT concat('s', CAST(l_suppkey AS STRING)) AS author_id, concat('o', CAST(l_partkey AS STRING)) AS action_object, CAST(NULL AS TIMESTAMP) AS created_at FROM lineitem""",
    ),
    "timed": (
        ("acts",),
        """SELECT DISTINCT concat('u', CAST(u AS STRING)) AS author_id, concat('o', CAST(k AS STRING)) AS action_object, ts AS created_at FROM acts""",
    ),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in BASE:
            for x in [*_needed(BASE[n][0]), n]:
                if x not in out:
                    out.append(x)
    return out


def duckdb_sql(names: str, body: str) -> str:
    """body, a SELECT or `cte AS (...), ... SELECT`, over the logical tables in names (space-separated)."""
    ctes = [f"{n} AS ({BASE[n][1].format(arr='list_value', strings='VARCHAR[]')})" for n in _needed(tuple(names.split()))]
    body = body.strip()
    head = "WITH "
    if "RECURSIVE " in body:  # one word for the whole WITH clause
        head, body = "WITH RECURSIVE ", body.replace("RECURSIVE ", "", 1)
    if ctes:
        head += ",\n".join(ctes)
    if body.upper().startswith("SELECT"):
        return f"{head}\n{body}" if ctes else body
    return f"{head},\n{body}" if ctes else f"{head}{body}"


class Tables:
    """The logical tables as DataFrames, and the synthetic ones, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                reads, sql = BASE[name]
                sql = sql.format(arr="array", strings="ARRAY<STRING>")
                views = {}
                for r in reads:
                    view = f"tidemark_{r}_{abs(hash((self.sf_dir, r))) % 10**8}"
                    getattr(self, r).createOrReplaceTempView(view)
                    views[r] = view
                import re

                for r, view in views.items():
                    sql = re.sub(rf"\b(FROM|JOIN) {r}\b", rf"\1 {view}", sql)
                self._made[name] = self.spark.sql(sql)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]
