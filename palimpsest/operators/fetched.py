"""Captures meet their payloads: join, redirects, paths and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import archive, content, paths, urls
from palimpsest.operators.versions import arrival
from palimpsest.session import cut_lineage

# Bits of an address filter: this many per address, in whole bitmaps of Spark's size, and 32 MB at most.
FILTER_BITS = 16
BITMAP_BITS = 32_768
MOST_FILTER_BITS = 1 << 28

# Fixed value: requests spent on following one redirect. The first repeats the
# redirecting address itself, so four further addresses are visited.
REDIRECT_REQUESTS = 5


def payload_index(payloads: DataFrame) -> DataFrame:
    """What deciding needs of a payload: status, location, and whether it is HTML.

    Bodies are unpacked and looked at where they are read; none is shuffled. A table that
    holds ``is_html`` already is not asked for its bodies at all.
    """
    if "is_html" in payloads.columns:
        return payloads.select("url_archive", "status", "location", "is_html")
    return content.decode_payload(payloads).select(
        "url_archive", "status", "location", content.is_html(F.col("body")).alias("is_html")
    )


def narrow_index(payloads: DataFrame) -> DataFrame:
    """Status and location per address, and ``is_html`` where the table holds it, else NULL.

    Enough to follow redirects; no body is read.
    """
    html = F.col("is_html") if "is_html" in payloads.columns else F.lit(None).cast("boolean").alias("is_html")
    return payloads.select("url_archive", "status", "location", html)


def address_filter(addresses: DataFrame) -> tuple[DataFrame, int]:
    """Bitmaps in which the hash of every address has set a bit, and how many bits they have together.

    ``addresses`` is a stored table of one column. The filter's size follows from their number and is
    bounded; beyond the bound it lets more other addresses pass, never fewer of its own.
    """
    wanted = max(FILTER_BITS * addresses.count(), BITMAP_BITS)
    bits = min(1 << (wanted - 1).bit_length(), MOST_FILTER_BITS)
    place = _filter_place(F.col(addresses.columns[0]), bits)
    places = addresses.select(place.alias("__place"))
    return (
        places.groupBy(F.bitmap_bucket_number("__place").alias("__bitmap"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits")),
        bits,
    )


def _filter_place(address: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(address), F.lit(bits)) + 1


def possibly_among(rows: DataFrame, column: str, addresses: DataFrame) -> DataFrame:
    """Rows whose address is among ``addresses``, and a few others: about one in ``FILTER_BITS``.

    The filter is broadcast, at 32 MB or less, and tested where rows are read, ahead of any shuffle; a
    bucketed table stays bucketed.
    """
    bitmaps, bits = address_filter(addresses)
    place = _filter_place(F.col(column), bits)
    position = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.call_function("substring", F.col("__bits"), F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    is_set = F.call_function("shiftright", byte.cast("int"), (position % 8).cast("int")).bitwiseAND(1) == 1
    given = rows.withColumn("__at", place).withColumn("__bitmap", F.bitmap_bucket_number("__at"))
    return given.join(F.broadcast(bitmaps), "__bitmap").where(is_set).select(*rows.columns)


def wanted_bodies(payloads: DataFrame, addresses: DataFrame) -> DataFrame:
    """Unpacked bodies of the addresses that will be written, with ``is_html``.

    ``addresses`` is a stored table of one column: small enough, it is sent to the bodies, and a
    table bucketed by address is read without a shuffle. Otherwise a filter of bounded size goes
    ahead, so that few bodies move that are not wanted. Only bodies that are left are unpacked.
    """
    goals = addresses.toDF("url_archive")
    near = possibly_among(payloads, "url_archive", goals)
    # an inner join: Spark would move a semi join ahead of the filter
    left = content.decode_payload(near.join(goals.distinct(), "url_archive"))
    return left.select("url_archive", "body", content.is_html(F.col("body")).alias("is_html"))


def with_sniffed(followed: DataFrame, bodies: DataFrame) -> DataFrame:
    """``followed`` with ``is_html`` of the body each row ends at."""
    known = bodies.select(F.col("url_archive").alias("body_address"), "is_html")
    return followed.drop("is_html").join(known, "body_address", "left")


def attach_payloads(captures: DataFrame, payloads: DataFrame) -> DataFrame:
    """Give every open capture its payload; ``payloads`` has one row per address.

    Any columns come along, whole payloads or an index of them. Closed captures and those
    without payload keep NULLs. The condition on ``response`` sits in the join, not in its
    key: the key stays unique on both sides and NULLs cannot pile up in one task. Bodies come
    along only past a filter of the open addresses, ahead of the join; ``captures`` is read
    once more for it and should be a stored table.
    """
    if "body" in payloads.columns:
        asked = cut_lineage(captures.where(F.col("response").isNull()).select("url_archive").distinct(), "asked")
        payloads = possibly_among(payloads, "url_archive", asked)
    given = payloads.select(
        F.col("url_archive").alias("__address"),
        *[c for c in payloads.columns if c != "url_archive"],
    )
    match = (F.col("url_archive") == F.col("__address")) & F.col("response").isNull()
    return captures.join(given, match, "left").drop("__address")


def resolve_redirects(
    attached: DataFrame, index: DataFrame, max_requests: int = REDIRECT_REQUESTS
) -> DataFrame:
    """Follow the 302 responses among ``attached`` through the payload index.

    Gives per redirecting capture ``redirect_url`` (its own address),
    ``redirect_timestamp`` (of the last location seen), ``redirect_target`` (last address
    visited), ``hops``, ``final_status`` and ``final_html``. Locations are always resolved
    against the first address. A target without payload leaves ``final_status`` NULL.

    Each hop is an equi join of a few narrow columns with the index, whose addresses are
    unique. Many rows may point at one target: adaptive execution splits such a partition
    of the left side, provided ``index`` is a stored table, as it is in a run, and not the
    end of a plan that is partitioned by address already. Finished rows are not shuffled
    under a shared NULL key, each gets a key of its own.
    """
    moved = attached.where((F.col("status") == 302) & F.col("location").isNotNull())
    walk = moved.select(
        "scid",
        F.col("url_archive").alias("__start"),
        archive.resolve_url(F.col("url_archive"), F.col("location")).alias("__next"),
        F.col("url_archive").alias("redirect_target"),
        F.col("status").alias("final_status"),
        F.col("is_html").alias("final_html"),
        F.lit(0).alias("hops"),
    ).withColumn("redirect_timestamp", archive.archive_timestamp(F.col("__next")))
    known = index.select(
        F.col("url_archive").alias("__key"),
        F.col("status").alias("__status"),
        F.col("location").alias("__location"),
        F.col("is_html").alias("__html"),
    )
    for _ in range(max_requests - 1):
        going = F.col("__next").isNotNull()
        key = F.when(going, F.col("__next")).otherwise(F.concat(F.lit("\0"), F.col("scid")))
        onward = archive.resolve_url(F.col("__start"), F.col("__location"))

        def moved_on(new: str, old: str, going: Column = going) -> Column:
            return F.when(going, F.col(new)).otherwise(F.col(old)).alias(old)

        walk = (
            walk.withColumn("__key", key)
            .join(known, "__key", "left")
            .withColumn("__onward", F.when(going, onward))
            .withColumn("__stamp", archive.archive_timestamp(F.col("__onward")))
            .select(
                "scid",
                "__start",
                F.col("__onward").alias("__next"),
                moved_on("__next", "redirect_target"),
                moved_on("__status", "final_status"),
                moved_on("__html", "final_html"),
                (F.col("hops") + going.cast("int")).alias("hops"),
                F.coalesce("__stamp", "redirect_timestamp").alias("redirect_timestamp"),
            )
        )
    return walk.select(
        "scid",
        F.col("__start").alias("redirect_url"),
        "redirect_timestamp",
        "redirect_target",
        "final_status",
        "final_html",
        "hops",
    )


def follow_redirects(attached: DataFrame, index: DataFrame) -> DataFrame:
    """``attached`` with redirects followed.

    ``status`` stays the first answer; ``final_status``, ``is_html`` and ``body_address``
    are those of the address a redirect ended at.
    """
    trails = resolve_redirects(attached, index).withColumn("__led", F.lit(True))
    base = attached.drop("redirect_url", "redirect_timestamp")
    led = F.col("__led").isNotNull()
    return (
        base.join(trails, "scid", "left")
        .withColumns(
            {
                "final_status": F.when(led, F.col("final_status")).otherwise(F.col("status")),
                "is_html": F.when(led, F.col("final_html")).otherwise(F.col("is_html")),
                "body_address": F.coalesce("redirect_target", "url_archive"),
            }
        )
        .drop("__led", "final_html")
    )


def redirect_ends(index: DataFrame) -> DataFrame:
    """Where each redirecting address of an index ends, however many hops away.

    Gives ``address, target, hops, loop``. Redirects are numbered in the order of their addresses, so that rounds
    move numbers and no texts. Pointers are doubled: a round replaces every pointer by the one
    of the redirect it points at, so that n hops take log n rounds; pointers that have come to a last redirect
    are not written again. A pointer that is still open after more
    hops than there are redirects to pass runs in circles; ``loop`` is then the smallest address of its
    circle, ``target`` and ``hops`` are NULL. Locations are resolved against the address that gives them,
    so a relative one may lead elsewhere than in ``resolve_redirects``. Many addresses may point at one:
    pointers are a stored table with unique addresses, so that adaptive execution splits such a key.
    """
    onward = archive.resolve_url(F.col("url_archive"), F.col("location"))
    moved = index.where((F.col("status") == 302) & F.col("location").isNotNull())
    ordered = moved.select(F.col("url_archive").alias("address"), onward.alias("target"))
    ordered = ordered.repartitionByRange("address").sortWithinPartitions("address")
    named = cut_lineage(ordered.withColumn("id", F.monotonically_increasing_id()), "redirects")
    heads = named.select(F.col("address").alias("target"), F.col("id").alias("__next"))
    state = named.select("id", "target").join(heads, "target", "left").select(
        "id",
        F.coalesce("__next", "id").alias("at"),
        F.when(F.col("__next").isNotNull(), 1).otherwise(0).cast("long").alias("steps"),
        F.col("__next").alias("least"),
        F.col("__next").isNotNull().alias("open"),
    )
    state = cut_lineage(state, "pointers")
    # a pointer that is not open stands at its last redirect
    tables, running, reach = [state], state.where("open"), 1
    while still := running.count():
        # a redirect that is still open and in no circle has at most this many hops to go
        enough = still + reach
        every = reduce(DataFrame.unionByName, [t.where("NOT open") for t in tables] + [running])
        there = every.select(
            F.col("id").alias("at"),
            F.col("at").alias("__at"),
            F.col("steps").alias("__steps"),
            F.col("least").alias("__least"),
            F.col("open").alias("__open"),
        )
        jumped = running.join(there, "at").select(
            "id",
            F.col("__at").alias("at"),
            (F.col("steps") + F.col("__steps")).alias("steps"),
            F.least("least", "__least").alias("least"),
            F.col("__open").alias("open"),
        )
        tables.append(cut_lineage(jumped, "pointers"))
        running = tables[-1].where("open")
        reach *= 2
        if reach >= enough:
            break
    closed = reduce(DataFrame.unionByName, [t.where("NOT open") for t in tables])
    own = named.select("id", "address")
    ended = closed.join(named.select(F.col("id").alias("at"), "target"), "at").join(own, "id").select(
        "address", "target", (F.col("steps") + 1).alias("hops"), F.lit(None).cast("string").alias("loop")
    )
    # a pointer this long stands inside its circle, and the one from there has been all round it
    rounds = running.select(F.col("id").alias("at"), F.col("least").alias("__least"))
    least = named.select(F.col("id").alias("__least"), F.col("address").alias("loop"))
    looping = running.select("id", "at").join(rounds, "at").join(least, "__least").join(own, "id").select(
        "address", F.lit(None).cast("string").alias("target"), F.lit(None).cast("long").alias("hops"), "loop"
    )
    return ended.unionByName(looping)


def resolve_redirects_fully(attached: DataFrame, index: DataFrame) -> DataFrame:
    """``resolve_redirects`` without a limit of requests.

    Gives ``scid, redirect_url, redirect_target, hops, final_status, loop``; in a loop the target is the
    address itself and ``final_status`` its own 302.
    """
    ends = cut_lineage(redirect_ends(index), "redirect-ends")
    moved = attached.where((F.col("status") == 302) & F.col("location").isNotNull()).select("scid", F.col("url_archive").alias("address"))
    known = index.select(F.col("url_archive").alias("redirect_target"), F.col("status").alias("final_status"))
    led = moved.join(ends, "address").select(
        "scid",
        F.col("address").alias("redirect_url"),
        F.coalesce("target", "address").alias("redirect_target"),
        "hops",
        "loop",
    )
    return led.join(known, "redirect_target", "left").select("scid", "redirect_url", "redirect_target", "hops", "final_status", "loop")


def without_redirects(attached: DataFrame) -> DataFrame:
    return attached.withColumns(
        {"final_status": F.col("status"), "body_address": F.col("url_archive")}
    )


def with_output_path(captures: DataFrame, mode: str, merge_www: bool = True, embedded: str = "cut") -> DataFrame:
    """Add ``rel_path``, the place below the output root; mode ``all`` adds a time level.

    Rows without key get it from the address inside their archive address.
    """
    key = F.coalesce(
        F.nullif(F.col("url_key"), F.lit("")),
        urls.url_key(archive.url_from_archive(F.col("url_archive")), merge_www, embedded),
    )
    stamp = F.col("timestamp") if mode == "all" else None
    return captures.withColumn("rel_path", paths.output_path(key, stamp))


def flag_long_paths(df: DataFrame, limit: int = paths.PATH_LIMIT, root: str = "") -> DataFrame:
    full = F.concat(F.lit(root), F.col("rel_path"))
    return df.withColumn("too_long", paths.path_too_long(full, limit))


def _folder_order(path: Column) -> Column:
    """A text in whose order a path is followed by what lies below it, before any other path.

    The slash becomes the lowest character; that one and the next are written as two.
    """
    free = F.replace(F.replace(path, F.lit("\x01"), F.lit("\x01\x01")), F.lit("\x00"), F.lit("\x01\x00"))
    return F.replace(free, F.lit("/"), F.lit("\x00"))


def path_conflicts(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Distinct paths of ``files`` that are also a folder of another path.

    ``stored`` holds paths of earlier runs, whose folders count as well. Paths are sorted over ranges so that
    whatever lies below a path comes next to it: a path is a folder if its successor begins
    with it. The successor of a range's last path is the first one of the next range, a row per range.
    One row per path is shuffled, however deep it lies.
    """
    own = files.select("rel_path", F.lit(True).alias("__own"))
    every = own if stored is None else own.unionByName(stored.select("rel_path", F.lit(False).alias("__own")))
    distinct = every.where("rel_path IS NOT NULL").groupBy("rel_path").agg(F.max("__own").alias("__own"))
    ranges = distinct.withColumn("__key", _folder_order(F.col("rel_path"))).repartitionByRange("__key")
    ordered = cut_lineage(ranges.withColumn("__range", F.spark_partition_id()), "sorted-paths")
    firsts = ordered.groupBy("__range").agg(F.min_by("rel_path", "__key").alias("__first"))
    carried = firsts.select("__range", F.lead("__first").over(W.orderBy("__range")).alias("__carried"))
    following = F.coalesce(F.lead("rel_path").over(W.partitionBy("__range").orderBy("__key")), F.col("__carried"))
    below = F.coalesce(F.col("__next").startswith(F.concat("rel_path", F.lit("/"))), F.lit(False))
    return ordered.join(carried, "__range").withColumn("__next", following).where(F.col("__own") & below).select("rel_path")


def settle_conflicts(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Move a file whose path is also a folder into that folder.

    HTML becomes its ``index.html``, anything else keeps its base name. ``is_html`` says
    which. A path moved onto another file shares its place, and ``write_once`` decides.
    Files of earlier runs stay where they are. The few conflicting paths are stored
    first: their size is then known to the join, and should one path hold very many files,
    adaptive execution can split it.
    """
    conflicts = cut_lineage(path_conflicts(files, stored), "clash")
    clash = conflicts.withColumn("__clash", F.lit(True))
    name = F.when(F.col("is_html"), F.lit("index.html")).otherwise(
        F.substring_index("rel_path", "/", -1)
    )
    moved = F.concat_ws("/", F.col("rel_path"), name)
    return (
        files.join(clash, "rel_path", "left")
        .withColumn("rel_path", F.when(F.col("__clash"), moved).otherwise(F.col("rel_path")))
        .select(*files.columns)
    )


def write_once(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add ``outcome``: the first arrival at a path is written, later ones find it there.

    Paths in ``stored`` are taken already. The first id per path is an aggregate that
    combines before its shuffle, and the winners are joined back by their own id. Both
    keys stay even when one path holds a third of all rows; ranking inside the path would
    put them all into one task.
    """
    order = arrival(files)
    first = F.min("scid") if len(order) == 1 else F.min_by("scid", F.struct(*order))
    winners = files.groupBy("rel_path").agg(first.alias("scid"))
    if stored is not None:
        winners = winners.join(stored.select("rel_path").distinct(), "rel_path", "left_anti")
    winners = winners.select("scid", F.lit(True).alias("__first"))
    outcome = F.when(F.col("__first"), "SUCCESS").otherwise("EXISTING")
    return files.join(winners, "scid", "left").withColumn("outcome", outcome).drop("__first")


def with_outcomes(
    fetched: DataFrame,
    mode: str,
    stored: DataFrame | None = None,
    merge_www: bool = True,
    embedded: str = "cut",
) -> DataFrame:
    """Outcome of every capture that has a payload; ``stored`` are paths of earlier runs.

    ``fetched`` carries ``status``, ``final_status`` and ``is_html``, no bodies. Adds
    ``outcome`` (``SUCCESS``, ``EXISTING``, ``UNKNOWN``), ``file`` and the first status as
    ``response``. Conflicts and first arrivals each look at all files more than once, so
    the narrow rows are stored between the steps.
    """
    had = cut_lineage(fetched.where(F.col("status").isNotNull()), "fetched")
    good = with_output_path(had.where("final_status = 200"), mode, merge_www, embedded)
    placed = paths.add_html_ext(F.col("rel_path"), F.coalesce("is_html", F.lit(False)))
    files = cut_lineage(good.select(*arrival(good), placed.alias("rel_path"), "is_html"), "placed")
    marks = write_once(cut_lineage(settle_conflicts(files, stored), "settled"), stored)
    return (
        had.join(marks.select("scid", F.col("rel_path").alias("__path"), "outcome"), "scid", "left")
        .withColumn("outcome", F.coalesce("outcome", F.lit("UNKNOWN")))
        .withColumn("file", F.col("__path"))
        .withColumn("response", F.col("status").cast("string"))
        .drop("__path")
    )


def stored_files(outcomes: DataFrame, payloads: DataFrame) -> DataFrame:
    """Files to write with their bodies, unpacked if ``payloads`` has an ``encoding``.

    Files of the captured address itself are unique by address. With payloads bucketed by
    address their bodies are not shuffled at all; otherwise a filter of the files' addresses goes
    ahead, so that few bodies move that no file is made of. Files a redirect led to may share one
    body by the million; those few bodies are set aside first, and adaptive execution can
    then split the files that wait for the same one.
    """
    files = outcomes.where("outcome = 'SUCCESS'").select(
        "url_archive",
        "body_address",
        "timestamp",
        F.split_part(F.col("file"), F.lit("/"), F.lit(1)).alias("domain"),
        F.col("file").alias("rel_path"),
    )
    files = cut_lineage(files, "files")
    packed = [c for c in ("encoding",) if c in payloads.columns]
    bodies = payloads.select(F.col("url_archive").alias("body_address"), *packed, "body")
    bodies = possibly_among(bodies, "body_address", cut_lineage(files.select("body_address").distinct(), "wanted"))
    own = F.col("url_archive") == F.col("body_address")
    led = files.where(~own)
    goals = led.select("body_address").distinct()
    shared = cut_lineage(bodies.join(goals, "body_address", "left_semi"), "targets")
    joined = files.where(own).join(bodies, "body_address").unionByName(led.join(shared, "body_address"))
    # unpacking comes after the joins: a Python step would hide the table's bucketing
    plain = content.decode_payload(joined).drop("encoding", "decode_ok") if packed else joined
    return plain.drop("body_address")
