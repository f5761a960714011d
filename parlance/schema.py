"""Table schemas and the defaults that are part of the semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = (
    "chat_id long, msg_id long, date long, edit_date long, from_id long, from_name string, reply_to_msg_id long, topic_id long, text string, "
    "media_kind string, media_filename string, media_state int, extracted string, reactions long, fwd_from_id long, fwd_msg_id long, fwd_from_name string, fwd_date long, "
    "links array<struct<kind:string,target:string>>, links_read boolean, lead_seq long, comment_of_chat_id long, comment_of_msg_id long, indexed boolean"
)
CHATS = (
    "id long, type string, title string, username string, peer_id long, scope string, is_forum boolean, is_broadcast boolean, discussion_of long, source_id string, "
    "unavailable boolean, last_msg_id long, last_sync_at long, migrated_to long"
)
UNITS = "chat_id long, topic_id long, kind string, msg_id_start long, msg_id_end long, msg_ids array<long>, date_start long, date_end long, text string, reactions long"


def conform(df: DataFrame, columns: str) -> DataFrame:
    """Just these columns in this order and of these types; one that is missing is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(columns).fields])


# Defaults of units, retrieval and ranking.
WINDOW_GAP_MIN = 30
WINDOW_MAX_MSGS = 30
WINDOW_MAX_CHARS = 1500
THREAD_MAX_MSGS = 40
K = 10
RRF_K = 60
RERANK_TOP = 40
DEDUP_OVERLAP = 0.5
REACTION_WEIGHT = 0.05
VEC_FANOUT_MAX = 8
KNN_OVERFETCH = 4
SNIPPET_CHARS = 600
EVIDENCE_CHARS = 240
EXTRACT_MAX_CHARS = 4000
DIRECTORY_MIN_CHATS = 10
EMBED_DIM = 256

# Chat ids of channels are marked by this offset, message ids are signed 32-bit, rows of a peer that
# another account's row already holds are numbered from the base, and chats of these types belong to all accounts.
CHANNEL_MARK = 10**12
MAX_MESSAGE_ID = 2**31 - 1
SYNTHETIC_BASE = 1 << 62
SHARED_TYPES = ("channel", "supergroup")
DEFAULT_ACCOUNT = "default"
IMPORT_PREFIX = "import:"
