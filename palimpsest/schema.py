"""Explicit schemas of the memory tiers, the edge table and the small side tables."""

from __future__ import annotations

_EMBEDDED = "embedding array<float>, "

EPISODES = "id string, session_id string, role string, content string, salience double, access_count long, last_accessed timestamp, consolidated_at timestamp, " + _EMBEDDED + "entities_json string, metadata map<string,string>, created_at timestamp, project_id string, forgotten_at timestamp"
DIGESTS = "id string, session_id string, summary string, key_topics array<string>, source_episode_ids array<string>, source_digest_ids array<string>, level int, " + _EMBEDDED + "metadata map<string,string>, created_at timestamp, project_id string"
SEMANTIC = "id string, topic string, content string, confidence double, source_digest_ids array<string>, source_episode_ids array<string>, access_count long, last_accessed timestamp, decay_rate double, supersedes string, superseded_by string, " + _EMBEDDED + "metadata map<string,string>, created_at timestamp, updated_at timestamp, valid_from timestamp, valid_until timestamp, project_id string, forgotten_at timestamp"
PROCEDURAL = "id string, category string, trigger string, procedure string, confidence double, observation_count long, last_observed timestamp, first_observed timestamp, access_count long, last_accessed timestamp, decay_rate double, source_episode_ids array<string>, " + _EMBEDDED + "metadata map<string,string>, created_at timestamp, updated_at timestamp, project_id string, forgotten_at timestamp"
ASSOCIATIONS = "id string, source_id string, source_type string, target_id string, target_type string, edge_type string, strength double, last_activated timestamp, metadata map<string,string>, created_at timestamp"
RUNS = "run_id string, cycle string, status string, started_at timestamp, completed_at timestamp, result_json string, duration_ms long"
COMMUNITIES = "community_id string, label string, member_count long, top_entities array<string>, top_topics array<string>, project_id string, updated_at timestamp"
SENSORY = "session_id string, snapshot_json string, saved_at timestamp"

TIERS = {"episode": EPISODES, "digest": DIGESTS, "semantic": SEMANTIC, "procedural": PROCEDURAL}
#: fixed values: roles, edge types and procedure categories of the data model
ROLES = ("user", "assistant", "system")
EDGE_TYPES = ("temporal", "causal", "topical", "supports", "contradicts", "elaborates", "derives_from", "co_recalled")
CATEGORIES = ("workflow", "preference", "habit", "pattern", "convention")
