"""Queries of the social part on derived tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators import social
from tessel.queries.registry import query, table
from tessel.streaming import jobs

_PROFILES = """prof AS (SELECT c_custkey AS user_id, kind, CASE WHEN kind = 'SOCIAL' AND c_custkey % 3 = 0 THEN 'PRIVATE' ELSE v END AS visibility, lower(kind) || '_' || substr(CAST(c_custkey AS VARCHAR), 1, 8) AS username FROM customer, (VALUES ('PROFESSIONAL', 'PUBLIC'), ('SOCIAL', 'PUBLIC'), ('PRIVATE', 'PRIVATE')) k(kind, v))"""
_CONN = """conn AS (SELECT DISTINCT o_custkey AS from_id, o_orderkey % (SELECT count(*) FROM customer) AS to_id, CASE o_orderkey % 3 WHEN 0 THEN 'FOLLOW' WHEN 1 THEN 'FRIEND' ELSE 'SUPER_PRIVATE_REQUEST' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END AS status FROM orders)"""
_POSTS = "posts AS (SELECT doc_id AS post_id, doc_id % (SELECT count(*) FROM customer) AS author, doc_id * 7919 % 100003 AS ts FROM documents)"
_LIKES = "likes AS (SELECT DISTINCT event_id % (SELECT count(*) FROM documents) AS post_id, user_id AS profile_id FROM events WHERE event_type = 'view')"
_COMM = "comm AS (SELECT conv_id % (SELECT count(*) FROM documents) AS post_id, turn, text FROM conversations)"
_MSGS = "msgs AS (SELECT conv_id, turn, role AS sender, text, conv_id % 100 AS p1, 100 + conv_id % 77 AS p2 FROM conversations)"
_VIEWS = "views AS (SELECT event_id, user_id AS viewer, event_id % 50 AS viewed, CASE event_id % 3 WHEN 0 THEN 'SOCIAL' WHEN 1 THEN 'PRIVATE' ELSE 'PROFESSIONAL' END AS network, ts FROM events WHERE event_type = 'view')"


def profiles(spark, d):
    p = social.default_profiles(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")))
    return p.withColumn("visibility", F.when((F.col("kind") == "SOCIAL") & (F.col("user_id") % 3 == 0), "PRIVATE").otherwise(F.col("visibility")))


def connections(spark, d):
    n = table(spark, d, "customer").count()
    k, s = F.col("o_orderkey") % 3, F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("from_id"), (F.col("o_orderkey") % n).alias("to_id"),
        F.when(k == 0, "FOLLOW").when(k == 1, "FRIEND").otherwise("SUPER_PRIVATE_REQUEST").alias("kind"),
        F.when(s == "F", "ACCEPTED").when(s == "O", "PENDING").otherwise("REJECTED").alias("status"),
    ).distinct()


def posts(spark, d):
    n = table(spark, d, "customer").count()
    return table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), (F.col("doc_id") % n).alias("author"), (F.col("doc_id") * 7919 % 100003).alias("ts"))


def likes(spark, d):
    n = table(spark, d, "documents").count()
    return table(spark, d, "events").filter("event_type = 'view'").select((F.col("event_id") % n).alias("post_id"), F.col("user_id").alias("profile_id"))


def comments(spark, d):
    n = table(spark, d, "documents").count()
    return table(spark, d, "conversations").select((F.col("conv_id") % n).alias("post_id"), "turn", "text")


def messages(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("sender"), "text", (F.col("conv_id") % 100).alias("p1"), (100 + F.col("conv_id") % 77).alias("p2"))


def views(spark, d):
    m = F.col("event_id") % 3
    return table(spark, d, "events").filter("event_type = 'view'").select("event_id", F.col("user_id").alias("viewer"), (F.col("event_id") % 50).alias("viewed"), F.when(m == 0, "SOCIAL").when(m == 1, "PRIVATE").otherwise("PROFESSIONAL").alias("network"), "ts")


@query("r1_r2_default_profiles", f"WITH {_PROFILES} SELECT user_id, kind, visibility, username FROM prof")
def r1(spark, d):
    return profiles(spark, d)


_ACC = "acc AS (SELECT from_id AS viewer, to_id AS owner, kind AS ck FROM conn WHERE status = 'ACCEPTED' UNION SELECT to_id, from_id, kind FROM conn WHERE status = 'ACCEPTED')"


@query("r3_profile_visibility", f"""WITH {_PROFILES}, {_CONN}, {_ACC}, req AS (SELECT user_id AS viewer, event_id % (SELECT count(*) FROM customer) AS owner, CASE event_id % 3 WHEN 0 THEN 'PROFESSIONAL' WHEN 1 THEN 'SOCIAL' ELSE 'PRIVATE' END AS kind, event_id FROM events)
SELECT viewer, owner, kind, visibility, count(*) AS n FROM req JOIN prof ON user_id = owner AND prof.kind = req.kind WHERE kind = 'PROFESSIONAL' OR (kind = 'SOCIAL' AND (visibility = 'PUBLIC' OR EXISTS (SELECT 1 FROM acc WHERE acc.viewer = req.viewer AND acc.owner = req.owner AND ck = 'FRIEND'))) OR (kind = 'PRIVATE' AND EXISTS (SELECT 1 FROM acc WHERE acc.viewer = req.viewer AND acc.owner = req.owner AND ck = 'SUPER_PRIVATE_REQUEST')) GROUP BY ALL""".replace("kind, visibility, count", "req.kind AS kind, visibility, count").replace("WHERE kind =", "WHERE req.kind =").replace("OR (kind =", "OR (req.kind ="))
def r3(spark, d):
    n = table(spark, d, "customer").count()
    m = F.col("event_id") % 3
    req = table(spark, d, "events").select(F.col("user_id").alias("viewer"), (F.col("event_id") % n).alias("owner"), F.when(m == 0, "PROFESSIONAL").when(m == 1, "SOCIAL").otherwise("PRIVATE").alias("kind"))
    return social.visible_profiles(req, profiles(spark, d), connections(spark, d)).groupBy("viewer", "owner", "kind", "visibility").agg(F.count("*").alias("n"))


@query("r4_update_profile", f"WITH {_PROFILES} SELECT user_id, kind, CASE kind WHEN 'PROFESSIONAL' THEN 'PUBLIC' WHEN 'PRIVATE' THEN 'PRIVATE' ELSE CASE WHEN user_id % 2 = 0 THEN 'PUBLIC' ELSE 'PRIVATE' END END AS visibility FROM prof")
def r4(spark, d):
    wanted = F.when(F.col("user_id") % 2 == 0, "PUBLIC").otherwise("PRIVATE")
    return profiles(spark, d).select("user_id", "kind", social.enforced_visibility(F.col("kind"), wanted).alias("visibility"))


@query("r5_daily_views", f"WITH {_VIEWS} SELECT viewer, viewed, network, CAST(ts AS DATE) AS day, min(ts) AS first_ts FROM views WHERE viewer <> viewed AND network <> 'PRIVATE' GROUP BY ALL")
def r5(spark, d):
    return social.daily_views(views(spark, d))


@query("r6_profile_viewers", f"WITH {_VIEWS} SELECT event_id, viewer, c_name FROM views JOIN customer ON c_custkey = viewer WHERE viewed = 7 ORDER BY ts DESC, event_id LIMIT 100")
def r6(spark, d):
    v = views(spark, d).filter("viewed = 7").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("viewer"))
    return v.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "viewer", "c_name")


@query("r7_create_connection", f"WITH {_CONN} SELECT DISTINCT c_custkey AS from_id, c_custkey % 10 AS to_id, 'FOLLOW' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM conn WHERE from_id = c_custkey AND to_id = c_custkey % 10 AND kind = 'FOLLOW')")
def r7(spark, d):
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("from_id"), (F.col("c_custkey") % 10).alias("to_id"), F.lit("FOLLOW").alias("kind"))
    return social.insert_missing(connections(spark, d), new, ["from_id", "to_id", "kind"])


@query("r8_update_status", f"WITH {_CONN} SELECT from_id, to_id, kind, CASE WHEN from_id % 2 = 0 THEN 'BLOCKED' ELSE status END AS status FROM conn")
def r8(spark, d):
    c = connections(spark, d)
    changes = c.select("from_id", "to_id", "kind", F.when(F.col("from_id") % 2 == 0, F.col("to_id")).otherwise(-1).alias("actor"), F.lit("BLOCKED").alias("new_status"))
    return social.updated_status(c, changes).select("from_id", "to_id", "kind", "status")


@query("r9_outgoing", f"WITH {_CONN} SELECT from_id, to_id, kind, c_name FROM conn JOIN customer ON c_custkey = to_id WHERE status = 'ACCEPTED' AND kind = 'FOLLOW'")
def r9(spark, d):
    c = connections(spark, d).filter("status = 'ACCEPTED' AND kind = 'FOLLOW'")
    return c.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("to_id")).select("from_id", "to_id", "kind", "c_name")


@query("r10_incoming_pending", f"WITH {_CONN} SELECT to_id, from_id, kind FROM conn WHERE status = 'PENDING'")
def r10(spark, d):
    return connections(spark, d).filter("status = 'PENDING'").select("to_id", "from_id", "kind")


@query("r11_profile_posts", f"WITH {_POSTS}, {_LIKES}, {_COMM} SELECT post_id, author, coalesce(nl, 0) AS n_likes, coalesce(nc, 0) AS n_comments FROM posts LEFT JOIN (SELECT post_id, count(*) AS nl FROM likes GROUP BY 1) USING (post_id) LEFT JOIN (SELECT post_id, count(*) AS nc FROM comm GROUP BY 1) USING (post_id)")
def r11(spark, d):
    nl = likes(spark, d).dropDuplicates().groupBy("post_id").agg(F.count("*").alias("nl"))
    nc = comments(spark, d).groupBy("post_id").agg(F.count("*").alias("nc"))
    out = posts(spark, d).join(nl, "post_id", "left").join(nc, "post_id", "left")
    return out.select("post_id", "author", F.coalesce("nl", F.lit(0)).alias("n_likes"), F.coalesce("nc", F.lit(0)).alias("n_comments"))


@query("r12_feed", f"""WITH {_CONN}, {_POSTS}, {_LIKES}, {_COMM}, f AS (SELECT viewer, post_id, author, CAST(row_number() OVER (PARTITION BY viewer ORDER BY ts DESC, post_id DESC) AS INTEGER) AS nth FROM (SELECT DISTINCT from_id AS viewer, to_id AS author FROM conn WHERE status = 'ACCEPTED') JOIN posts USING (author))
SELECT viewer, post_id, author, nth, coalesce(nl, 0) AS n_likes, coalesce(nc, 0) AS n_comments FROM f LEFT JOIN (SELECT post_id, count(*) AS nl FROM likes GROUP BY 1) USING (post_id) LEFT JOIN (SELECT post_id, count(*) AS nc FROM comm GROUP BY 1) USING (post_id) WHERE nth <= 50""")
def r12(spark, d):
    edges = connections(spark, d).filter("status = 'ACCEPTED'").select(F.col("from_id").alias("viewer"), F.col("to_id").alias("author"))
    return social.feed(edges, posts(spark, d), likes(spark, d), comments(spark, d))


@query("r13_like_unlike", f"WITH {_LIKES} SELECT post_id, profile_id FROM likes WHERE profile_id % 4 <> 0")
def r13(spark, d):
    undone = likes(spark, d).filter("profile_id % 4 = 0")
    return likes(spark, d).dropDuplicates().join(undone, ["post_id", "profile_id"], "left_anti")


@query("r14_comments", f"WITH {_COMM} SELECT post_id, CAST(row_number() OVER (PARTITION BY post_id ORDER BY turn, text) AS INTEGER) AS nth, text FROM comm")
def r14(spark, d):
    nth = F.row_number().over(Window.partitionBy("post_id").orderBy("turn", "text"))
    return comments(spark, d).select("post_id", nth.alias("nth"), "text")


@query("r15_delete_post", f"WITH {_POSTS}, {_LIKES} SELECT l.post_id, count(*) AS n FROM likes l JOIN posts p ON p.post_id = l.post_id WHERE author % 7 <> 0 GROUP BY 1")
def r15(spark, d):
    gone = posts(spark, d).filter("author % 7 = 0").select("post_id")
    return likes(spark, d).dropDuplicates().join(gone, "post_id", "left_anti").groupBy("post_id").agg(F.count("*").alias("n"))


@query("r16_conversation_key", f"WITH {_CONN} SELECT DISTINCT least(from_id, to_id) AS p1, greatest(from_id, to_id) AS p2, kind = 'SUPER_PRIVATE_REQUEST' AS encrypted FROM conn")
def r16(spark, d):
    c = connections(spark, d)
    return c.select(*social.conversation_key(F.col("from_id"), F.col("to_id")), (F.col("kind") == "SUPER_PRIVATE_REQUEST").alias("encrypted")).distinct()


@query("r17_conversation_permission", f"WITH {_CONN} SELECT DISTINCT viewer, owner FROM (SELECT from_id AS viewer, to_id AS owner FROM conn WHERE status = 'ACCEPTED' AND kind = 'SUPER_PRIVATE_REQUEST' UNION ALL SELECT to_id, from_id FROM conn WHERE status = 'ACCEPTED' AND kind = 'SUPER_PRIVATE_REQUEST')")
def r17(spark, d):
    return social.accepted_pairs(connections(spark, d), "SUPER_PRIVATE_REQUEST")


@query("r18_messages", f"WITH {_MSGS} SELECT conv_id, turn, sender, text FROM msgs WHERE (p1 = 7 OR p2 = 107)")
def r18(spark, d):
    return messages(spark, d).filter("p1 = 7 OR p2 = 107").select("conv_id", "turn", "sender", "text")


@query("r19_conversations", f"WITH {_MSGS}, c AS (SELECT conv_id, p1, p2, max(turn) AS updated FROM msgs GROUP BY ALL), w AS (SELECT p1 AS id FROM c UNION SELECT p2 FROM c) SELECT id AS me, conv_id, updated FROM c JOIN w ON p1 = id UNION ALL SELECT id, conv_id, updated FROM c JOIN w ON p2 = id WHERE p1 <> p2")
def r19(spark, d):
    c = messages(spark, d).groupBy("conv_id", "p1", "p2").agg(F.max("turn").alias("updated"))
    who = c.select(F.col("p1").alias("id")).union(c.select("p2")).distinct()
    return social.either_slot(c, who).select("me", "conv_id", "updated")


@query("r20_mark_read", f"WITH {_MSGS} SELECT conv_id, turn, CASE WHEN (p1 = 7 OR p2 = 7) AND turn % 2 = 1 THEN 1 END AS read_at FROM msgs")
def r20(spark, d):
    m = messages(spark, d).withColumn("sender", F.when(F.col("turn") % 2 == 0, 7).otherwise(-1)).withColumn("read_at", F.lit(None).cast("int"))
    return social.mark_read(m, F.lit(7), F.lit(1)).select("conv_id", "turn", "read_at")


@query("r21_encrypted_roundtrip", "SELECT conv_id, turn, text, 3 AS parts, 24 AS iv, 32 AS tag, CAST(2 * octet_length(encode(text)) AS INTEGER) AS cipher, true AS guarded FROM conversations")
def r21(spark, d):
    """The message's parts have their lengths, it comes back by its key, and a changed one doesn't."""
    key = F.lit("0123456789abcdef0123456789abcdef")
    m = table(spark, d, "conversations").withColumn("message", social.encrypted(F.col("text"), key)).withColumn("p", F.split("message", ":"))
    changed = F.concat(F.when(F.substring("message", 1, 1) == "0", "1").otherwise("0"), F.substring("message", 2, 1 << 30))
    sizes = [F.length(F.col("p")[i]).alias(n) for i, n in enumerate(("iv", "tag", "cipher"))]
    return m.select("conv_id", "turn", social.decrypted(F.col("message"), key).alias("text"), F.size("p").alias("parts"), *sizes, social.decrypted(changed, key).isNull().alias("guarded"))


_LOC = "loc AS (SELECT user_id, 4805e-2 + (user_id * 37 % 200) * 1e-5 AS lat, 113e-1 + (user_id * 91 % 200) * 1e-5 AS lon FROM (SELECT DISTINCT user_id FROM events))"
_HAV = "2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def locations(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    return u.select("user_id", (48.05 + (F.col("user_id") * 37 % 200) * 1e-5).alias("lat"), (11.3 + (F.col("user_id") * 91 % 200) * 1e-5).alias("lon"))


@query("r22_r23_nearby", f"WITH {_LOC} SELECT a.user_id AS me, b.user_id AS other, round({_HAV}, 3) AS meters FROM loc a JOIN loc b ON a.user_id <> b.user_id WHERE {_HAV} <= 50")
def r22(spark, d):
    loc = locations(spark, d)
    return social.nearby(loc, loc, 50.0, digits=3)


@query("r24_radar_position")
def r24(spark, d):
    return table(spark, d, "customer").select("c_custkey", *social.radar_position(F.col("c_name"), (F.col("c_custkey") % 80).cast("double")))


@query("r25_ghost_look", "SELECT event_id, round(least(value / 60e0, 1e0), 6) AS progress, round(1 - 7e-1 * least(value / 60e0, 1e0), 6) AS opacity, round(1 + 2e-1 * least(value / 60e0, 1e0), 6) AS scale FROM events")
def r25(spark, d):
    return table(spark, d, "events").select("event_id", *social.ghost_look(F.col("value")))


_NOW = "CAST('2024-01-31 00:00:00' AS TIMESTAMP)"


@query("st1_st3_r29_presence_rollup", f"SELECT status, count(*) AS n FROM (SELECT user_id, CASE WHEN g <= 43200 THEN 'ACTIVE' WHEN g <= 216000 THEN 'GHOSTING' ELSE 'OFFLINE' END AS status FROM (SELECT user_id, epoch_us({_NOW}) / 1e6 - epoch_us(max(ts)) / 1e6 AS g FROM events GROUP BY 1)) GROUP BY 1")
def st1(spark, d):
    return social.presence(table(spark, d, "events"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 43200, 172800).groupBy("status").agg(F.count("*").alias("n"))


@query("st2_st4_presence_spans", "SELECT event_id, user_id, g AS gap_s, CASE WHEN g IS NULL OR g > 216000 THEN 'OFFLINE' WHEN g > 43200 THEN 'GHOSTING' ELSE 'ACTIVE' END AS next_state FROM (SELECT event_id, user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS g FROM events)")
def st2(spark, d):
    return social.presence_spans(table(spark, d, "events"), 43200, 172800)


@query("st5_ttl_entries", f"SELECT user_id, max(ts) AS set_at FROM events GROUP BY 1 HAVING epoch_us(max(ts)) + CAST(259200000000 AS BIGINT) > epoch_us({_NOW})")
def st5(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("set_at"))
    return e.filter(F.unix_micros(F.col("set_at").cast("timestamp")) + 259200000000 > F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")))


@query("st6_rate_limit", "SELECT event_id, user_id, CAST(n AS INTEGER) AS nth, n <= 2 AS allowed, CAST(greatest(0, 2 - n) AS INTEGER) AS remaining FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) AS n FROM events)")
def st6(spark, d):
    return social.rate_limited(table(spark, d, "events"), 2, 86400)


@query("st7_online_set", "SELECT user_id FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def st7(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("e"))
    return last.filter("e <> 'error'").select("user_id")


@query("st8_enter_leave", "WITH x AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), y AS (SELECT *, lag(day) OVER w AS p, lead(day) OVER w AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, day, p IS NULL OR p <> day - 1 AS enters, n IS NULL OR n <> day + 1 AS leaves FROM y")
def st8(spark, d):
    x = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    p, n = F.lag("day").over(w), F.lead("day").over(w)
    return x.select("user_id", "day", (p.isNull() | (p != F.date_sub("day", 1))).alias("enters"), (n.isNull() | (n != F.date_add("day", 1))).alias("leaves"))


@query("r26_auth_filters", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def r26(spark, d):
    revoked = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").filter("c_acctbal > 0").join(revoked, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("r26_register", "WITH u AS (SELECT 'u' || (c_custkey % 500) || '@x' AS email, c_name AS phone FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, 'u' || (c_custkey % 700) || '@x' AS email, c_name AS phone FROM customer WHERE 'u' || (c_custkey % 700) || '@x' NOT IN (SELECT email FROM u) AND c_name NOT IN (SELECT phone FROM u)")
def r26r(spark, d):
    """Every customer asks to register; every second one is a user already, by email or phone."""
    c = table(spark, d, "customer")
    mail = lambda n: F.concat(F.lit("u"), (F.col("c_custkey") % n).cast("string"), F.lit("@x")).alias("email")
    users = c.filter("c_custkey % 2 = 0").select(mail(500), F.col("c_name").alias("phone"))
    return social.registered(users, c.select("c_custkey", mail(700), F.col("c_name").alias("phone")))


@query("r26_refresh", f"SELECT event_id AS token, user_id FROM events WHERE event_type = 'signup' AND epoch_us(ts) + CAST(604800000000 AS BIGINT) >= epoch_us({_NOW}) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)")
def r26t(spark, d):
    """Tokens of a week from each sign-up; those of users that logged out are gone, and expired ones are refused."""
    e = table(spark, d, "events")
    tokens = e.filter("event_type = 'signup'").select(F.col("event_id").alias("token"), "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) + 604800000000).alias("expires_at"))
    left = tokens.join(e.filter("event_type = 'error' and value > 90").select("user_id").distinct(), "user_id", "left_semi").select("token")
    now = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return social.refreshed(social.logged_out(tokens, left), tokens.select("token"), now)


@query("st9_deliveries", "SELECT e.user_id % 10 AS room, m.c_custkey AS user_id, e.event_id FROM events e JOIN customer m ON m.c_nationkey = e.user_id % 10 WHERE m.c_custkey <> e.user_id AND e.event_type = 'signup'")
def st9(spark, d):
    """Sign-ups to all customers of their room."""
    e = table(spark, d, "events").filter("event_type = 'signup'").select((F.col("user_id") % 10).alias("room"), F.col("user_id").alias("sender"), "event_id")
    m = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("room"), F.col("c_custkey").alias("user_id"))
    return jobs.deliveries(e, m)


@query("r27_user_with_profiles", f"WITH {_PROFILES} SELECT user_id, c_name, kind, username FROM prof JOIN customer ON c_custkey = user_id")
def r27(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return profiles(spark, d).join(c, "user_id").select("user_id", "c_name", "kind", "username")


@query("r28_constraint_checks", f"WITH {_CONN} SELECT 'unique' AS rule, count(*) AS broken FROM (SELECT 1 FROM conn GROUP BY from_id, to_id, kind HAVING count(*) > 1) UNION ALL SELECT 'reference', count(*) FROM conn WHERE to_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'check', count(*) FROM conn WHERE from_id = to_id")
def r28(spark, d):
    c = connections(spark, d)
    one = c.groupBy("from_id", "to_id", "kind").count().filter("count > 1").agg(F.lit("unique").alias("rule"), F.count("*").alias("broken"))
    two = c.join(table(spark, d, "customer"), F.col("to_id") == F.col("c_custkey"), "left_anti").agg(F.lit("reference").alias("rule"), F.count("*").alias("broken"))
    return one.unionByName(two).unionByName(c.filter("from_id = to_id").agg(F.lit("check").alias("rule"), F.count("*").alias("broken")))
