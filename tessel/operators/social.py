"""Relational queries of a social network: profiles, connections, feed, messages, proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EARTH_M = 6371000.0
ACTIVE_S, GHOST_S = 15, 60


def default_profiles(users: DataFrame) -> DataFrame:
    """Three profiles a user (user_id): kind, visibility and a name from the first eight characters of the id."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("visibility")) for k, v in (("PROFESSIONAL", "PUBLIC"), ("SOCIAL", "PUBLIC"), ("PRIVATE", "PRIVATE"))))
    return users.select("user_id", F.inline(kinds)).withColumn("username", F.concat(F.lower("kind"), F.lit("_"), F.substring(F.col("user_id").cast("string"), 1, 8)))


def accepted_pairs(connections: DataFrame, kind: str) -> DataFrame:
    """(viewer, owner) in both directions of accepted connections of a kind."""
    c = connections.filter((F.col("status") == "ACCEPTED") & (F.col("kind") == kind))
    return c.select(F.col("from_id").alias("viewer"), F.col("to_id").alias("owner")).unionByName(c.select(F.col("to_id").alias("viewer"), F.col("from_id").alias("owner"))).distinct()


def visible_profiles(requests: DataFrame, profiles: DataFrame, connections: DataFrame) -> DataFrame:
    """requests (viewer, owner, kind) that may see the profile (user_id, kind, visibility)."""
    p = requests.join(profiles.select(F.col("user_id").alias("owner"), "kind", "visibility"), ["owner", "kind"])
    friends = accepted_pairs(connections, "FRIEND").withColumn("friend", F.lit(True))
    private = accepted_pairs(connections, "SUPER_PRIVATE_REQUEST").withColumn("private", F.lit(True))
    p = p.join(friends, ["viewer", "owner"], "left").join(private, ["viewer", "owner"], "left")
    ok = (F.col("kind") == "PROFESSIONAL") | ((F.col("kind") == "SOCIAL") & ((F.col("visibility") == "PUBLIC") | F.col("friend").isNotNull())) | ((F.col("kind") == "PRIVATE") & F.col("private").isNotNull())
    return p.filter(ok).select("viewer", "owner", "kind", "visibility")


def enforced_visibility(kind: Column, wanted: Column) -> Column:
    return F.when(kind == "PROFESSIONAL", "PUBLIC").when(kind == "PRIVATE", "PRIVATE").otherwise(wanted)


def daily_views(views: DataFrame) -> DataFrame:
    """First view a day of (viewer, viewed, network); none of oneself, none on the private network."""
    ok = views.filter((F.col("viewer") != F.col("viewed")) & (F.col("network") != "PRIVATE"))
    return ok.groupBy("viewer", "viewed", "network", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_ts"))


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, one a key, whose key isn't there yet."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def updated_status(connections: DataFrame, changes: DataFrame) -> DataFrame:
    """connections with the status of changes (from_id, to_id, kind, actor, new_status) where the actor is the recipient."""
    c = changes.filter(F.col("actor") == F.col("to_id")).select("from_id", "to_id", "kind", "new_status").dropDuplicates(["from_id", "to_id", "kind"])
    return connections.join(c, ["from_id", "to_id", "kind"], "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def feed(viewer_edges: DataFrame, posts: DataFrame, likes: DataFrame, comments: DataFrame, k: int = 50) -> DataFrame:
    """Newest k posts a viewer by authors with an accepted outgoing edge (viewer, author), with like and comment counts."""
    mine = viewer_edges.select("viewer", "author").distinct().join(posts, "author")
    nth = F.row_number().over(Window.partitionBy("viewer").orderBy(F.desc("ts"), F.desc("post_id")))
    mine = mine.withColumn("nth", nth).filter(F.col("nth") <= k)
    n_likes = likes.dropDuplicates(["post_id", "profile_id"]).groupBy("post_id").agg(F.count("*").alias("n_likes"))
    n_comments = comments.groupBy("post_id").agg(F.count("*").alias("n_comments"))
    out = mine.join(n_likes, "post_id", "left").join(n_comments, "post_id", "left")
    return out.select("viewer", "post_id", "author", "nth", F.coalesce("n_likes", F.lit(0)).alias("n_likes"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"))


def conversation_key(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("p1"), F.greatest(a, b).alias("p2")]


def mark_read(messages: DataFrame, reader: Column, now: Column) -> DataFrame:
    """messages with read_at set where the reader takes part and isn't the sender."""
    part = (reader == F.col("p1")) | (reader == F.col("p2"))
    return messages.withColumn("read_at", F.when(F.col("read_at").isNull() & part & (reader != F.col("sender")), now).otherwise(F.col("read_at")))


def either_slot(rows: DataFrame, who: DataFrame, a: str = "p1", b: str = "p2") -> DataFrame:
    """rows whose slot a or b is one of who(id), with that id: two equi-joins instead of an OR."""
    one = rows.join(who.select(F.col("id").alias(a), F.col("id").alias("me")), a)
    two = rows.filter(F.col(a) != F.col(b)).join(who.select(F.col("id").alias(b), F.col("id").alias("me")), b)
    return one.unionByName(two)


def encrypted(text: Column, key: Column, iv: Column | None = None) -> Column:
    """`iv:tag:cipher` in lower-case hexadecimal, by AES in Galois counter mode; key has 32 bytes.

    The start value has 12 bytes, the length that Spark's function takes; by default it is drawn anew for every row.
    """
    raw = F.hex(F.aes_encrypt(text, key, F.lit("GCM")) if iv is None else F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), iv))
    n = F.length(raw)
    return F.lower(F.concat_ws(":", F.substring(raw, 1, 24), F.substring(raw, n - 31, F.lit(32)), F.substring(raw, F.lit(25), n - 56)))


def decrypted(message: Column, key: Column) -> Column:
    """Text of an encrypted message; null if it was changed or the key is another."""
    part = F.split(message, ":")
    return F.try_aes_decrypt(F.unhex(F.concat(part[0], part[2], part[1])), key, F.lit("GCM")).cast("string")


def registered(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of wanted(email, phone, ...) whose email and phone no user has; null ones match nothing."""
    free = wanted.join(users.select("email").filter("email is not null").distinct(), "email", "left_anti")
    return free.join(users.select("phone").filter("phone is not null").distinct(), "phone", "left_anti").select(*wanted.columns)


def refreshed(tokens: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """(token, user_id) of the tokens asked for that exist and have not expired: expires_at is not before now."""
    return tokens.join(asked.select("token").distinct(), "token", "left_semi").filter(F.col("expires_at") >= now).select("token", "user_id")


def logged_out(tokens: DataFrame, left: DataFrame) -> DataFrame:
    """tokens without those of left(token)."""
    return tokens.join(left.select("token").distinct(), "token", "left_anti")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


#: Users of one place that are taken together, in the mean.
RUN = 256


def _places(rows: DataFrame) -> DataFrame:
    """(lat, lon, ids): the users of one place, about RUN in an array, so that no array holds a whole crowd."""
    n = rows.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    run = F.pmod(F.xxhash64("user_id"), F.ceil(F.col("n") / RUN))
    return rows.join(n, ["lat", "lon"]).select("user_id", "lat", "lon", run.alias("run")).groupBy("lat", "lon", "run").agg(F.collect_list("user_id").alias("ids")).drop("run")


def nearby(callers: DataFrame, users: DataFrame, radius_m: float = 50.0, digits: int | None = None) -> DataFrame:
    """(me, other, meters) of users (user_id, lat, lon) within the radius of callers, without themselves; meters to `digits` places.

    Both sides meet in grid cells no smaller than the radius, so only neighbouring cells are compared. Cell width in
    longitude follows the row's own band of latitude. Places are compared, not users: a distance is found once for all
    users of two places, and each pair of arrays of users is dealt to any task before it is multiplied out. Pairs are made
    distinct only if some user is at several places, as a pair can't come up twice otherwise.
    """
    one = callers.select("user_id", "lat", "lon").distinct()
    two = one if users is callers else users.select("user_id", "lat", "lon").distinct()
    moving = any(not t.groupBy("user_id").count().filter("count > 1").isEmpty() for t in ([one] if two is one else [one, two]))
    deg = radius_m / 111_000.0
    band = F.floor(F.col("lat") / deg)
    width = lambda b: deg / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs(b * deg) + 2 * deg))))
    cells = _places(two).withColumn("cy", band).withColumn("cx", F.floor(F.col("lon") / width(F.col("cy"))))
    around = _places(one).withColumn("cy", F.explode(F.array(band - 1, band, band + 1)))
    x = F.floor(F.col("lon") / width(F.col("cy")))
    around = around.withColumn("cx", F.explode(F.array(x - 1, x, x + 1))).select(F.col("ids").alias("mine"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), "cy", "cx")
    meters = haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    parts = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = around.repartition(parts, "cy", "cx").join(cells.repartition(parts, "cy", "cx"), ["cy", "cx"]).select("mine", "ids", meters.alias("meters")).filter(F.col("meters") <= radius_m)
    shown = F.col("meters") if digits is None else F.round("meters", digits)
    both = both if moving else both.withColumn("meters", shown)
    out = both.repartition(parts).select(F.explode("mine").alias("me"), "ids", "meters").select("me", F.explode("ids").alias("other"), "meters").filter(F.col("me") != F.col("other"))
    return out.distinct().withColumn("meters", shown) if moving else out


def presence(pings: DataFrame, now: Column, active_s: float = ACTIVE_S, ghost_s: float = GHOST_S) -> DataFrame:
    """(user_id, last_ping, status) at `now` from pings(user_id, ts): ACTIVE, then GHOSTING, then OFFLINE."""
    last = pings.groupBy("user_id").agg(F.max("ts").alias("last_ping"))
    gap = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col("last_ping").cast("timestamp")) / 1e6
    return last.withColumn("status", F.when(gap <= active_s, "ACTIVE").when(gap <= active_s + ghost_s, "GHOSTING").otherwise("OFFLINE"))


def presence_spans(pings: DataFrame, active_s: float = ACTIVE_S, ghost_s: float = GHOST_S) -> DataFrame:
    """(user_id, ts, gap_s, next_state): what becomes of each ping before the user's next one (null: the last ping)."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    state = F.when(gap.isNull() | (gap > active_s + ghost_s), "OFFLINE").when(gap > active_s, "GHOSTING").otherwise("ACTIVE")
    return pings.select("event_id", "user_id", gap.alias("gap_s"), state.alias("next_state"))


def rate_limited(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Per event its place in the user's tumbling window, whether it is allowed and what remains."""
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    nth = F.row_number().over(Window.partitionBy("user_id", "bucket").orderBy("ts", "event_id"))
    out = events.withColumn("bucket", bucket).withColumn("nth", nth)
    return out.select("event_id", "user_id", "nth", (F.col("nth") <= limit).alias("allowed"), F.greatest(F.lit(0), F.lit(limit) - F.col("nth")).alias("remaining"))


def radar_hash(text: Column) -> Column:
    """Rolling 31-hash of a text's characters, kept inside 32 signed bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    step = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % F.lit(1 << 32))
    return F.when(step >= (1 << 31), step - (1 << 32)).otherwise(step)


def radar_position(user_id: Column, meters: Column, radius: float = 100.0) -> list[Column]:
    angle = F.radians((F.abs(radar_hash(user_id.cast("string"))) % 360).cast("double"))
    r = 0.8 * radius * F.least(meters / 50.0, F.lit(1.0))
    return [F.round(r * F.cos(angle), 6).alias("x"), F.round(r * F.sin(angle), 6).alias("y")]


def ghost_look(elapsed_s: Column) -> list[Column]:
    p = F.least(elapsed_s / 60.0, F.lit(1.0))
    return [F.round(p, 6).alias("progress"), F.round(1 - 0.7 * p, 6).alias("opacity"), F.round(1 + 0.2 * p, 6).alias("scale")]
