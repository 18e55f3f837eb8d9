"""Table layouts. Time is always data or an `as_of` argument, never the clock."""

MESSAGES = "id long, user_id string, message_key string, role string, content string, content_hash string, ordinal int, client_message_id string, metadata_json string, created_at timestamp"
MEMORY = (
    "id long, user_id string, content string, type string, topic_key string, subject string, predicate string, value string, scope string, confidence double, "
    "importance double, stability double, freshness double, information_gain double, source_message_ids array<string>, supersedes_id long, contradicts_ids array<long>, "
    "related_ids array<long>, relationship string, status string, version int, valid_from timestamp, valid_until timestamp, created_at timestamp, updated_at timestamp"
)
#: The memory as the fold writes it: `changed_at` is the place, in the user's candidates, of what changed an item last.
ITEM = f"{MEMORY}, changed_at long"


def names(layout: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in layout.split(", ")]


CORRECTIONS = "user_id string, target string, old_value string, new_value string, status string, source_message_ids array<string>, created_at timestamp"
CONTEXT_VERSIONS = "user_id string, version int, kind string, state_json string, source_message_ids array<string>, created_at timestamp"
USERS = "user_id string, created_at timestamp"
CONTEXT = "user_id string, key string, value string, written_at timestamp, expires_at timestamp"
CANDIDATE = (
    "user_id string, ordinal long, content string, type string, topic_key string, authority string, is_correction boolean, subject string, predicate string, value string, "
    "scope string, correction struct<target:string,old_value:string,new_value:string>, revocation struct<target:string,value:string>, source_message_ids array<string>, as_of timestamp"
)
