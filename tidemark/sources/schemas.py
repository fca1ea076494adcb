"""Declared schemas of the run-file tables, their partitions, keys and order columns."""

from __future__ import annotations

#: Columns and types of each table (without its partition columns).
POSTS = (
    "platform_post_id string, url string, author_id string, author_handle string, author_name string, text string, lang string, created_at timestamp, collected_at timestamp, query string, "
    "conversation_id string, in_reply_to_id string, repost_of_id string, quoted_post_id string, is_repost boolean, is_quote boolean, like_count bigint, repost_count bigint, reply_count bigint, quote_count bigint, view_count bigint, "
    "hashtags array<string>, mentions array<string>, urls array<string>, media array<string>, place string, latitude double, longitude double"
)
METRICS = "platform_post_id string, like_count bigint, repost_count bigint, reply_count bigint, quote_count bigint, view_count bigint, collected_at timestamp"
AUTHORS = (
    "platform_user_id string, handle string, display_name string, bio string, location string, followers_count bigint, following_count bigint, tweet_count bigint, listed_count bigint, verified boolean, blue boolean, "
    "created_at timestamp, profile_image_url string, collected_at timestamp"
)
ENGAGEMENTS = "platform_post_id string, platform_user_id string, kind string, collected_at timestamp"
FOLLOWS = "follower_id string, followed_id string, collected_at timestamp"
SCORES = "platform_post_id string, label string, p_hate double, hate_flag boolean, in_scope boolean, coded_suspect boolean, explicit_toxic boolean, domain string, scored_at timestamp"
EDGES = "src string, dst string, weight double, p_value double, min_gap double, sig_bonferroni boolean, sig_fdr boolean, sig_percentile boolean, computed_at timestamp"
CLUSTERS = "cluster_id string, author_id string, cluster_name string, size bigint, computed_at timestamp"
RUNS = "pass string, n_items bigint, n_rows bigint, started_at timestamp, ended_at timestamp, error string"

MANIFEST = "run_id string, target_type string, term string, source string, fp_risk string, query string, since string, until string, n_posts bigint, collected_at timestamp"

#: table -> (schema, partition columns, key of the latest state (empty: a series), order column)
TABLES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...], str]] = {
    "posts": (POSTS, ("platform", "type", "dt"), ("platform", "platform_post_id"), "collected_at"),
    "metrics": (METRICS, ("platform", "dt"), (), "collected_at"),
    "authors": (AUTHORS, ("platform", "dt"), ("platform", "platform_user_id"), "collected_at"),
    "engagements": (ENGAGEMENTS, ("platform", "dt"), ("platform", "platform_post_id", "platform_user_id", "kind"), "collected_at"),
    "follows": (FOLLOWS, ("platform", "dt"), ("platform", "follower_id", "followed_id"), "collected_at"),
    "collection_runs": (MANIFEST, ("platform", "dt"), (), "collected_at"),
    "census_runs": (RUNS, ("platform", "dt"), (), "started_at"),
    "embeddings": ("platform_post_id string, embedding array<float>, embedded_at timestamp", ("platform", "model", "dt"), ("platform_post_id",), "embedded_at"),
    "labels": ("platform_post_id string, sentiment string, emotion string, labeled_at timestamp", ("platform", "dt"), ("platform_post_id",), "labeled_at"),
    "incitement": ("platform_post_id string, dehumanisation_score double, violence_call_score double, othering_score double, political_criticism_score double, lexicon_hits array<string>, lexicon_categories array<string>, scored_at timestamp", ("platform", "dt"), ("platform_post_id",), "scored_at"),
    "hatespeech": (SCORES, ("platform", "dt"), ("platform_post_id",), "scored_at"),
    "coordination/edges": (EDGES, ("platform", "channel", "method", "dt"), ("src", "dst", "channel", "method"), "computed_at"),
    "coordination/clusters": (CLUSTERS, ("platform", "dt"), ("cluster_id", "author_id"), "computed_at"),
    "coordination/run_metrics": ("channel string, metric string, value double, computed_at timestamp", ("platform", "dt"), (), "computed_at"),
    "stories": ("story_id bigint, stable_story_id string, tier string, size bigint, story_suspicion_index double, high_suspicion boolean, computed_at timestamp", ("platform", "dt"), (), "computed_at"),
}
