"""Link discovery: leads from messages, their evidence, candidates ranked by independent origins, and what a session keeps.

A session's state is tables: ``candidates`` (CANDIDATES), ``evidence`` (EVIDENCE), ``cursors`` (CURSORS), and exclusions
(chat). Each step takes them and gives them anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import schema
from parlance.functions import links as ln
from parlance.functions import text as tx
from parlance.operators.components import components
from parlance.operators.ordered import placed
from parlance.storage import checkpointed, spread

CANDIDATES = "chat string, peer_id long, username string, invite string, slug string, depth int, status string, decided boolean"
EVIDENCE = "chat string, chat_id long, msg_id long, via string, origin string, snippet string"
CURSORS = "chat_id long, depth int, index_id string, after long, directory boolean"
_LEADS = "array<struct<kind:string,target:string>>"


def chat_level(target: Column) -> Column:
    """The chat that an identity belongs to: of a post its chat, of a person nothing."""
    person = target.startswith("peer:") & ~target.startswith("peer:-")
    public = F.regexp_extract(target, r"^(@[^/]+)", 1)
    private = F.regexp_extract(target, r"^c/(\d+)/", 1)
    return F.when(person, None).when(public != "", public).when(private != "", F.concat(F.lit("peer:"), (-(private.cast("long") + schema.CHANNEL_MARK)).cast("string"))).otherwise(target)


def post_key(peer: Column, msg_id: Column) -> Column:
    """One post, wherever it is seen: where it stands, forwarded, or found by a search for posts."""
    return F.concat(F.lit("post:"), peer.cast("string"), F.lit("/"), msg_id.cast("string"))


def folder_key(slug: Column) -> Column:
    return F.concat(F.lit("addlist:"), slug)


def chat_search_key(peer: Column) -> Column:
    return F.concat(F.lit("chat_search:"), peer.cast("string"))


def origin_key() -> Column:
    """What counts as one origin of evidence, of a message joined with its chat's ``type``, ``scope`` and ``peer_id``.

    A forwarded post, and that post itself, is the post; a forward of which only the author is known is author and
    time (0 if unknown); a hidden author is none. Any other message is itself, named as its chat is everywhere.
    """
    author = F.concat(F.lit("fwd:"), F.col("fwd_from_id").cast("string"), F.lit("@"), F.coalesce("fwd_date", F.lit(0)).cast("string"))
    own = F.concat(F.lit("msg:"), F.coalesce("scope", F.lit("")), F.lit(":"), F.col("peer_id").cast("string"), F.lit("/"), F.col("msg_id").cast("string"))
    return (
        F.when(F.col("fwd_from_id").isNotNull() & F.col("fwd_msg_id").isNotNull(), post_key(F.col("fwd_from_id"), F.col("fwd_msg_id")))
        .when(F.col("fwd_from_id").isNotNull(), author)
        .when(F.col("type").isin(*schema.SHARED_TYPES), post_key(F.col("peer_id"), F.col("msg_id")))
        .otherwise(own)
    )


_TEXT_MAY_LINK = r"(?i)@|t\.me|telegram\.me|telegram\.dog|tg:"


def lead_rows(messages: DataFrame) -> DataFrame:
    """Messages that may name a chat: by links, by where they were forwarded from, or, while their links are unread, by their text."""
    read = F.coalesce("links_read", F.lit(False)) | F.col("links").isNotNull()
    return messages.where(F.col("fwd_from_id").isNotNull() | (F.size(F.coalesce("links", F.array().cast(_LEADS))) > 0) | (~read & F.col("text").rlike(_TEXT_MAY_LINK)))


def message_leads(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """(chat_id, msg_id, via, target, chat, origin, snippet): what messages name by links, forwards and text; ``chat`` is null for people.

    Links that were never read (null) are looked for in the text: a text's links are cut out first, and only then is
    each one parsed, in the text's row, so that no text is moved once for each of its links.
    """
    about = chats.select(F.col("id").alias("chat_id"), "type", "scope", "peer_id")
    columns = ["chat_id", "msg_id", "text", "links", "links_read", "fwd_from_id", "fwd_msg_id", "fwd_date"]
    rows = lead_rows(spread(schema.conform(messages, schema.MESSAGES).select(*columns))).join(about, "chat_id")
    shown = F.when(F.col("links").isNull() & ~F.coalesce("links_read", F.lit(False)), ln.spans(F.col("text")))
    forward = F.when(F.col("fwd_from_id").isNotNull(), F.array(F.struct(F.lit("forward").alias("kind"), F.concat(F.lit("peer:"), F.col("fwd_from_id").cast("string")).alias("target"))))
    none = F.array().cast(_LEADS)
    every = F.concat(F.coalesce("links", shown, none), F.coalesce(forward, none))
    named = F.transform(every, lambda l: F.struct(l["kind"].alias("via"), ln.identity(l["target"]).alias("target")))
    told = F.array_distinct(F.filter(named, lambda l: l["target"].isNotNull()))  # a text may say it twice
    # texts stay in their rows until snippets are cut; of a plain explode Spark asks first whether it gives rows, and parses all twice
    each = rows.select("chat_id", "msg_id", tx.one_line(F.col("text")).alias("_flat"), origin_key().alias("origin"), F.explode_outer(told).alias("l")).where("l is not null")
    each = each.select("chat_id", "msg_id", "_flat", "origin", F.col("l.via").alias("via"), F.col("l.target").alias("target"))
    needle = F.regexp_replace(F.col("target"), r"^(@|\+|addlist/)|/.*$", "")
    found = each.select("chat_id", "msg_id", "via", "target", chat_level(F.col("target")).alias("chat"), "origin", tx.flat_snippet(F.col("_flat"), needle, schema.EVIDENCE_CHARS).alias("snippet"))
    return found.dropDuplicates(["chat_id", "msg_id", "via", "target"])


def own_names(chats: DataFrame) -> DataFrame:
    """(chat_id, chat): the identities that name each chat itself."""
    names = F.array(F.concat(F.lit("peer:"), F.col("peer_id").cast("string")), F.concat(F.lit("@"), F.lower("username")))
    return chats.select(F.col("id").alias("chat_id"), F.explode(names).alias("chat")).where("chat is not null")


def collect_leads(messages: DataFrame, chats: DataFrame, cursors: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """Leads to chats from messages whose leads changed after each chat's tick (chat_id, after), without people and a chat's own names."""
    rows = messages
    if cursors is not None:
        after = cursors.select("chat_id", F.col("after").alias("_after"))
        rows = messages.join(after, "chat_id").where(F.coalesce("lead_seq", F.lit(0)) > F.coalesce("_after", F.lit(0))).drop("_after")
    if upto is not None:
        rows = rows.where(F.coalesce("lead_seq", F.lit(0)) <= upto)
    return message_leads(rows, chats).where("chat is not null").join(own_names(chats), ["chat_id", "chat"], "left_anti")


def evidence(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Evidence with new rows added where the same path of the same message is not there yet; nulls are equal."""
    keys = ["chat", "chat_id", "msg_id", "via", "origin"]
    known = stored.select(F.xxhash64(*keys).alias("_path"), F.struct(*keys).alias("_key"))
    new = fresh.dropDuplicates(keys).withColumn("_path", F.xxhash64(*keys)).withColumn("_own", F.struct(*keys))
    new = new.join(known, (F.col("_own").eqNullSafe(F.col("_key"))) & (new["_path"] == known["_path"]), "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def candidates(found: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """(chat, corroboration, mentions, chats, depth): how many distinct origins name each chat, from how many chats."""
    rows = found.join(depth.select("chat_id", "depth"), "chat_id", "left") if depth is not None else found.withColumn("depth", F.lit(0))
    return rows.groupBy("chat").agg(F.countDistinct("origin").alias("corroboration"), F.count("*").alias("mentions"), F.countDistinct("chat_id").alias("chats"), (F.min(F.coalesce("depth", F.lit(0))) + 1).cast("int").alias("depth"))


def question_terms(question: str) -> list[str]:
    """Stems of a question's words of three letters and more that are no numbers."""
    return list(dict.fromkeys(tx.stem_token(t) for t in tx.token_list(question) if len(t) >= 3 and not t.isdigit()))


def with_overlap(cands: DataFrame, found: DataFrame, question: str = "") -> DataFrame:
    """Candidates with ``overlap``: how many of the question's words their snippets share, together."""
    terms = question_terms(question)
    if not terms:
        return cands.withColumn("overlap", F.lit(0))
    told = found.select("chat", F.explode(F.array_intersect(tx.stems(tx.tokens(F.col("snippet"))), F.array(*map(F.lit, terms)))).alias("t"))
    shared = told.groupBy("chat").agg(F.countDistinct("t").cast("int").alias("overlap"))
    return cands.join(shared, "chat", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def _best() -> list[Column]:
    return [F.desc("corroboration"), F.desc("overlap"), F.col("depth"), F.col("chat")]


def ranked(cands: DataFrame, found: DataFrame, question: str = "") -> DataFrame:
    """Candidates by corroboration, then by how many of the question's words their snippets share, depth and name."""
    return placed(with_overlap(cands, found, question), _best(), "rank")


def propose(cands: DataFrame, known: DataFrame, excluded: DataFrame, max_depth: int, room: int) -> DataFrame:
    """The best ``room`` candidates that are not known or excluded yet and within the depth."""
    new = cands.where(F.col("depth") <= max_depth).join(known.select("chat"), "chat", "left_anti").join(excluded.select("chat"), "chat", "left_anti")
    new = new if "overlap" in new.columns else new.withColumn("overlap", F.lit(0))
    return new.orderBy(*_best()).limit(room)


def named_chats(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """(chat_id, chat): the distinct chats that each chat's stored links and forwards name, itself not among them."""
    targets = ln.identified(link_targets(messages), "target", "_id").where("_id is not null")
    return targets.select("chat_id", chat_level(F.col("_id")).alias("chat")).where("chat is not null").distinct().join(own_names(chats), ["chat_id", "chat"], "left_anti")


def directories(named: DataFrame, least: int = schema.DIRECTORY_MIN_CHATS) -> DataFrame:
    """(chat_id, names): chats that name many distinct chats are lists of chats."""
    return named.groupBy("chat_id").agg(F.countDistinct("chat").alias("names")).where(F.col("names") >= least)


def directory_evidence(found: DataFrame, lists: DataFrame) -> DataFrame:
    """Evidence by way of directories: what leads in them prove, over again as ``directory``, of the same origin."""
    return found.where("via <> 'directory'").join(lists.select("chat_id").distinct(), "chat_id", "left_semi").withColumn("via", F.lit("directory"))


def scan_targets(seeds: DataFrame, fetched: DataFrame, chats: DataFrame) -> DataFrame:
    """(chat_id, depth): seeds at depth 0, fetched chats at their least depth, and the discussion groups of both."""
    base = seeds.select("chat_id", F.lit(0).alias("depth")).unionByName(fetched.select("chat_id", F.col("depth").cast("int").alias("depth")))
    groups = chats.select(F.col("id").alias("_group"), F.col("discussion_of").alias("chat_id")).join(base, "chat_id").select(F.col("_group").alias("chat_id"), "depth")
    return base.unionByName(groups).groupBy("chat_id").agg(F.min("depth").alias("depth"))


def held(cands: DataFrame, chats: DataFrame) -> DataFrame:
    """(chat, chat_id): candidates that are chats of the index, by id or by name: two equi-joins, no OR."""
    by_id = cands.select("chat").join(chats.select(F.concat(F.lit("peer:"), F.col("peer_id").cast("string")).alias("chat"), F.col("id").alias("chat_id")), "chat")
    by_name = cands.select("chat").join(chats.select(F.concat(F.lit("@"), F.lower("username")).alias("chat"), F.col("id").alias("chat_id")), "chat")
    return by_id.unionByName(by_name).distinct()


def link_targets(messages: DataFrame) -> DataFrame:
    """(chat_id, target): distinct link targets and forward origins of each chat."""
    said = messages.select("chat_id", F.explode("links").alias("l")).select("chat_id", F.col("l.target").alias("target"))
    sent = messages.where("fwd_from_id is not null").select("chat_id", F.concat(F.lit("peer:"), F.col("fwd_from_id").cast("string")).alias("target"))
    return said.union(sent).distinct()


# ------------------------------------------------------------------- identities


def same_chats(identities: DataFrame) -> DataFrame:
    """(id, group): candidates that are one chat, by the least id.

    Rows of one peer id are one chat, and rows of different peer ids never are, whatever names they share. Rows
    without a peer id belong together by a shared user name or invite, transitively; such a group joins the one peer
    that its names lead to, or, where they lead to several, the peer whose oldest row has the least id.
    """
    names = F.array(F.concat(F.lit("u"), F.lower("username")), F.concat(F.lit("i"), F.col("invite")))
    named = checkpointed(identities.select("id", "peer_id", F.explode(names).alias("key")).where("key is not null"))
    free = named.where("peer_id is null").select("id", "key")
    hubs = free.groupBy("key").agg(F.min("id").alias("b"))
    near, _ = components(free.join(hubs, "key").select(F.col("id").alias("a"), "b"))
    state = checkpointed(identities.where("peer_id is null").select("id").join(near.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("least", "id").alias("group")))
    peers = identities.where("peer_id is not null").groupBy("peer_id").agg(F.min("id").alias("first"))
    keyed = named.where("peer_id is not null").join(peers, "peer_id").groupBy("key").agg(F.min(F.struct("first", "peer_id")).alias("peer"))
    led = free.join(keyed, "key").join(state, "id").groupBy("group").agg(F.min("peer").alias("peer"))
    loose = state.join(led, "group", "left").select("id", F.col("peer.peer_id").alias("peer_id"), "group")
    fixed = identities.where("peer_id is not null").select("id", "peer_id", F.col("id").alias("group"))
    every = loose.unionByName(fixed).withColumn("_key", F.when(F.col("peer_id").isNotNull(), F.concat(F.lit("p"), F.col("peer_id").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("group").cast("string"))))
    least = every.groupBy("_key").agg(F.min("id").alias("_least"))
    return every.join(least, "_key").select("id", F.col("_least").alias("group"))


def merged_candidates(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One candidate for each group of ``same_chats``: the oldest row, its unknown fields filled from the others in order, the least depth.

    A row with a decision (``decided``) is never folded away: it stays beside the oldest.
    """
    keyed = rows.join(groups, "id")
    stays = F.coalesce("decided", F.lit(False)) & (F.col("id") != F.col("group"))
    fields = [c for c in rows.columns if c not in ("id", "depth", "decided", "status")]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("id", c)))[c].alias(c)
    one = keyed.where(~stays).groupBy("group").agg(F.min("id").alias("id"), F.min("depth").alias("depth"), *[first(c) for c in fields], F.min(F.struct("id", "decided", "status")).alias("_own"))
    kept = one.select("id", *fields, "depth", F.col("_own.decided").alias("decided"), F.col("_own.status").alias("status")).select(*rows.columns)
    return kept.unionByName(keyed.where(stays).select(*rows.columns))


def renamed_away(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates of a known peer that go by a name which now is another peer's, (username, peer_id)."""
    now = names.select(F.lower("username").alias("_name"), F.col("peer_id").alias("_peer"))
    return rows.where("peer_id is not null").withColumn("_name", F.lower("username")).join(now, "_name").where("peer_id <> _peer").select(*rows.columns).distinct()


def excluded_by(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Candidates that an exclusion (chat, peer_id, username) covers under any of their spellings."""
    by = lambda own, other: rows.join(exclusions.select(other.alias("_k")).where("_k is not null").distinct(), own == F.col("_k"), "left_semi")
    found = by(F.col("chat"), F.col("chat")).unionByName(by(F.col("peer_id"), F.col("peer_id"))).unionByName(by(F.lower("username"), F.lower("username")))
    return found.distinct()


# -------------------------------------------------------------------- discovery


@dataclass
class Discovery:
    """What one round of discovery leaves, and counts of what it met."""

    candidates: DataFrame
    evidence: DataFrame
    cursors: DataFrame
    new: DataFrame
    lists: DataFrame
    counts: dict[str, int]


def discover(
    messages: DataFrame, chats: DataFrame, seeds: DataFrame, known: DataFrame, proofs: DataFrame, cursors: DataFrame, exclusions: DataFrame, index_id: str,
    question: str = "", max_depth: int = 2, room: int = 50, least: int = schema.DIRECTORY_MIN_CHATS,
) -> Discovery:
    """Read a session's chats from where it last stopped and record what they lead to.

    Chats are the seeds (chat_id) and those with cursors, with their discussion groups. Leads to chats that are read
    already count as known. Leads to known candidates are evidence; the best ``room`` new ones within ``max_depth``
    become candidates. A chat that had a lead cut off by the room keeps its cursor, so that the lead comes again. A
    cursor of another index reads from the start.
    """
    targets = checkpointed(scan_targets(seeds, cursors.select("chat_id", "depth"), chats))
    places = cursors.where(F.col("index_id") == index_id).select("chat_id", "after")
    asked = targets.join(places, "chat_id", "left").select("chat_id", "depth", F.coalesce("after", F.lit(0)).alias("after"))
    upto = messages.join(targets.select("chat_id"), "chat_id", "left_semi").groupBy("chat_id").agg(F.max(F.coalesce("lead_seq", F.lit(0))).alias("newest"))
    found = checkpointed(collect_leads(messages, chats, asked))
    inside = held(found.select("chat").distinct(), chats.join(targets.select(F.col("chat_id").alias("id")), "id", "left_semi")).select("chat").distinct()
    in_session = found.join(inside, "chat", "left_semi").count()
    found = checkpointed(found.join(inside, "chat", "left_anti"))
    ranks = with_overlap(candidates(found, asked), found, question)
    old = ranks.join(known.select("chat"), "chat", "left_semi")
    rest = ranks.join(known.select("chat"), "chat", "left_anti")
    deep = rest.where(F.col("depth") > max_depth)
    barred = rest.where(F.col("depth") <= max_depth).join(exclusions.select("chat"), "chat", "left_semi")
    open_ = checkpointed(rest.where(F.col("depth") <= max_depth).join(exclusions.select("chat"), "chat", "left_anti"))
    new = checkpointed(open_.orderBy(*_best()).limit(room))
    over = open_.join(new.select("chat"), "chat", "left_anti")
    back = found.join(over.select("chat"), "chat", "left_semi").select("chat_id").distinct()
    kind = F.col("chat")
    rows = new.select(
        "chat", F.when(kind.startswith("peer:"), F.expr("try_cast(substring(chat, 6) as bigint)")).alias("peer_id"), F.when(kind.startswith("@"), F.substring(kind, F.lit(2), F.length(kind))).alias("username"),
        F.when(kind.startswith("+"), F.substring(kind, F.lit(2), F.length(kind))).alias("invite"), F.when(kind.startswith("addlist/"), F.substring(kind, F.lit(9), F.length(kind))).alias("slug"),
        "depth", F.lit("proposed").alias("status"), F.lit(False).alias("decided"),
    )
    shallower = old.select("chat", F.col("depth").alias("_d"))
    kept = known.join(shallower, "chat", "left").withColumn("depth", F.least("depth", "_d").cast("int")).select(*known.columns)
    every = kept.unionByName(schema.conform(rows, CANDIDATES).select(*known.columns))
    proven = evidence(proofs, schema.conform(found.join(every.select("chat"), "chat", "left_semi"), EVIDENCE))
    lists = checkpointed(directories(named_chats(messages.join(found.select("chat_id").distinct(), "chat_id", "left_semi"), chats), least))
    marked = cursors.where("directory").select("chat_id")
    proven = evidence(proven, directory_evidence(proven, lists.select("chat_id").union(marked).distinct()))
    moved = targets.join(upto, "chat_id", "left").join(back.withColumn("_back", F.lit(True)), "chat_id", "left").join(asked.select("chat_id", "after"), "chat_id")
    moved = moved.join(lists.select("chat_id", F.lit(True).alias("_list")), "chat_id", "left").join(marked.withColumn("_was", F.lit(True)), "chat_id", "left")
    after = F.when(F.col("_back"), F.col("after")).otherwise(F.greatest("after", F.coalesce("newest", F.lit(0))))
    now = moved.select("chat_id", "depth", F.lit(index_id).alias("index_id"), after.cast("long").alias("after"), F.coalesce("_list", "_was", F.lit(False)).alias("directory"))
    counts = {"in_session": in_session, "leads": found.count(), "new": new.count(), "known": old.count(), "beyond_depth": deep.count(), "excluded": barred.count(), "over_room": over.count()}
    return Discovery(every, proven, schema.conform(now, CURSORS), rows, lists, counts)


def decide(known: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with the statuses (chat, status) that someone gave them."""
    said = decisions.select("chat", F.col("status").alias("_status"))
    joined = known.join(said, "chat", "left")
    return joined.withColumn("decided", F.coalesce("decided", F.lit(False)) | F.col("_status").isNotNull()).withColumn("status", F.coalesce("_status", "status")).select(*known.columns)


def granted(grants: DataFrame, now: int) -> DataFrame:
    """Grants (chat, until, left) that still hold: not expired and not used up."""
    return grants.where((F.col("until").isNull() | (F.col("until") >= now)) & (F.col("left") > 0))


def consumed(grants: DataFrame, used: DataFrame) -> DataFrame:
    """Grants less what was used of each (chat, n); never below nothing."""
    spent = used.groupBy("chat").agg(F.sum("n").alias("_n"))
    return grants.join(spent, "chat", "left").withColumn("left", F.greatest(F.lit(0), F.col("left") - F.coalesce("_n", F.lit(0)))).select(*grants.columns)


def first_seen(proofs: DataFrame) -> DataFrame:
    """(chat, chat_id, msg_id, origin): the first piece of evidence of each candidate."""
    best = F.min(F.struct("chat_id", "msg_id", "origin")).alias("e")
    return proofs.groupBy("chat").agg(best).select("chat", "e.*")
