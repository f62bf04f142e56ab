"""Chords and progressions added to a table, one row in and one row out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.functions import dims
from gridprobe.functions import fixed_values as fv
from gridprobe.functions import pitch
from gridprobe.functions.binding import let
from gridprobe.functions.literals import literal_map, map_text, sql_text
from gridprobe.operators import grid


def _known(value: str, key: str, what: str) -> str:
    """SQL text for a looked-up value; an unknown key fails the job with its name."""
    return f"coalesce({value}, raise_error(concat('unknown {what}: ', coalesce(cast({key} as string), 'null'))))"


def _lookup(mapping: dict, key: str, what: str) -> str:
    return _known(f"try_element_at({map_text(mapping)}, {key})", key, what)


def stacked_thirds(degree: str, chord_type: str) -> str:
    """SQL text: 0-based scale places of every second degree from the root up."""
    size = _lookup(fv.CHORD_SIZE, chord_type, "chord type")
    return f"transform(sequence(0, {size} - 1), i -> cast(({degree} - 1 + i * 2) % 7 as int))"


def quality_of(pitch_classes: str) -> str:
    """SQL text: chord quality from the third and the fifth above the root."""
    third, fifth = (f"pmod({pitch_classes}[{i}] - {pitch_classes}[0], 12)" for i in (1, 2))
    names = {f"{t},{f}": name for (t, f), name in fv.CHORD_QUALITY.items()}
    return _lookup(names, f"concat({third}, ',', {fifth})", "chord quality")


def inverted(values: str, inversion: str, raise_by: int) -> str:
    """SQL text: move the lowest one ("6") or two ("64") entries to the end, raised by ``raise_by``."""
    moved = f"(case {inversion} when '6' then 1 when '64' then 2 else 0 end)"
    bottom = f"transform(slice({values}, 1, {moved}), n -> n + {raise_by})"
    return f"concat(slice({values}, {moved} + 1, size({values})), {bottom})"


def bass_doubled(notes: Column) -> Column:
    return F.concat(F.array((notes[0] - 12).cast("int")), notes)


def add_chord(
    df: DataFrame,
    root: str,
    mode: str,
    degree: str,
    chord_type: str,
    inversion: str | None = None,
    extensions: str | None = None,
    borrowed: str | None = None,
    name: str = "chord",
) -> DataFrame:
    """Add a struct (pitch_classes, notes, name) for a chord on a degree of a scale.

    Notes sit at the tonic plus the scale offset without carrying the octave. A borrowed mode
    replaces the scale but keeps the tonic. Extensions index the scale from zero. The name takes its
    letter from the lowest note after inversion.
    """
    inv = f"`{inversion}`" if inversion else "cast(null as string)"
    lent = f"`{borrowed}`" if borrowed else "cast(null as string)"
    ext = f"`{extensions}`" if extensions else "cast(array() as array<int>)"
    # Staged columns, so that each array is computed once. Every mode starts on its root.
    staged = df.withColumns({
        "_home": F.expr(f"cast(pmod(`{root}`, 12) as int)"),
        "_offsets": F.expr(_lookup(fv.MODE_OFFSETS, f"coalesce({lent}, `{mode}`)", "mode")),
        "_places": F.expr(stacked_thirds(f"`{degree}`", f"`{chord_type}`")),
    })
    staged = staged.withColumn("_tonic", pitch.tonic_note(F.col("_home"))).withColumns({
        "_pcs": F.expr("transform(_places, p -> pmod(_home + element_at(_offsets, p + 1), 12))"),
        "_notes": F.expr("transform(_places, p -> _tonic + element_at(_offsets, p + 1))"),
        "_added_pcs": F.expr(f"transform({ext}, e -> pmod(_home + element_at(_offsets, e % 7 + 1), 12))"),
        "_added": F.expr(f"transform({ext}, e -> _tonic + 12 + element_at(_offsets, e % 7 + 1))"),
    })
    letter = f"element_at({sql_text(fv.SHARP_NAMES)}, _pcs_out[0] + 1)"
    suffix = f"element_at({map_text(fv.CHORD_SUFFIX)}, `{chord_type}`)"
    added = f"if(size({ext}) > 0, concat('add', array_join(cast({ext} as array<string>), '')), '')"
    source = f"if({lent} is null, '', concat(' (', {lent}, ')'))"
    label = f"concat({letter}, {quality_of('_pcs')}, {suffix}, coalesce({inv}, ''), '[', {added}, {source}, ']')"
    return (
        staged.withColumn("_pcs_out", F.expr(f"concat({inverted('_pcs', inv, 0)}, _added_pcs)"))
        .withColumn(name, F.expr(
            f"named_struct('pitch_classes', _pcs_out, 'notes', concat({inverted('_notes', inv, 12)}, _added), "
            f"'name', {label})"
        ))
        .drop("_home", "_offsets", "_places", "_tonic", "_pcs", "_notes", "_added_pcs", "_added", "_pcs_out")
    )


def chord_table(spark: SparkSession) -> DataFrame:
    """Every plain chord: 12 roots x 11 modes x 7 degrees x 5 types x 3 inversions, 13,860 rows."""
    sizes = {"_r": 12, "_m": len(fv.MODE_OFFSETS), "_d": 7, "_t": len(fv.CHORD_SIZE), "_i": len(fv.INVERSIONS)}
    ids = grid.grid_ids(spark, list(sizes.values()), "_id")
    keyed = grid.with_ordinals(ids, "_id", **sizes).select(
        F.col("_r").alias("_root"),
        dims.pick(list(fv.MODE_OFFSETS), F.col("_m")).alias("_mode"),
        (F.col("_d") + 1).alias("_degree"),
        dims.pick(list(fv.CHORD_SIZE), F.col("_t")).alias("_type"),
        dims.pick(fv.INVERSIONS, F.col("_i")).alias("_inversion"),
    )
    return add_chord(keyed, "_root", "_mode", "_degree", "_type", "_inversion", name="_entry")


def join_chord(
    df: DataFrame, root: str, mode: str, degree: str, chord_type: str, inversion: str | None = None,
    name: str = "chord",
) -> DataFrame:
    """Like ``add_chord`` for plain chords of a large table, through the dictionary of all chords.

    Building a chord takes a dozen array steps; looking it up takes one probe of a broadcast table whose
    size is fixed by the music, not by the data. Roots are pitch classes 0..11.
    """
    table = chord_table(df.sparkSession)
    same = [
        F.col(root) == F.col("_root"),
        F.col(mode) == F.col("_mode"),
        F.col(degree) == F.col("_degree"),
        F.col(chord_type) == F.col("_type"),
    ]
    if inversion:
        wanted = F.when(F.col(inversion).isin(*[i for i in fv.INVERSIONS if i]), F.col(inversion))
        same.append(F.coalesce(wanted, F.lit("5")) == F.coalesce("_inversion", F.lit("5")))
    else:
        table = table.filter(F.col("_inversion").isNull())
    joined = df.join(F.broadcast(table), reduce(lambda a, b: a & b, same), "left")
    key = F.concat_ws(" ", *[F.col(c).cast("string") for c in (root, mode, degree, chord_type)])
    return joined.withColumn(name, pitch.known(F.col("_entry"), key, "chord")).drop(
        "_root", "_mode", "_degree", "_type", "_inversion", "_entry"
    )


def named_chord_table(spark: SparkSession) -> DataFrame:
    """Every named chord: 5 recipes x 12 roots x 3 inversions."""
    kinds = [r[0] for r in fv.CHORD_RECIPES]
    ids = grid.grid_ids(spark, [len(kinds), 12, len(fv.INVERSIONS)], "_id")
    keyed = grid.with_ordinals(ids, "_id", _k=len(kinds), _pc=12, _i=len(fv.INVERSIONS)).select(
        dims.pick(kinds, F.col("_k")).alias("_key_kind"),
        F.col("_pc").alias("_key_root"),
        dims.pick(fv.INVERSIONS, F.col("_i")).alias("_key_inversion"),
    )
    return add_named_chord(keyed, "_key_root", "_key_kind", "_key_inversion", name="_entry")


def join_named_chord(df: DataFrame, root: str, kind: str, inversion: str | None = None, name: str = "chord") -> DataFrame:
    """Like ``add_named_chord`` for a large table, through the dictionary of 180 named chords."""
    table = named_chord_table(df.sparkSession)
    same = (F.col(kind) == F.col("_key_kind")) & (F.col(root) == F.col("_key_root"))
    if inversion:
        wanted = F.when(F.col(inversion).isin(*[i for i in fv.INVERSIONS if i]), F.col(inversion))
        same &= F.coalesce(wanted, F.lit("5")) == F.coalesce("_key_inversion", F.lit("5"))
    else:
        table = table.filter(F.col("_key_inversion").isNull())
    joined = df.join(F.broadcast(table), same, "left")
    return joined.withColumn(name, pitch.known(F.col("_entry"), F.col(kind), "chord kind")).drop(
        "_key_kind", "_key_root", "_key_inversion", "_entry"
    )


def add_named_chord(df: DataFrame, root: str, kind: str, inversion: str | None = None, name: str = "chord") -> DataFrame:
    """Add a chord by recipe name (major, minor, aug, dim, dom7) through the recipe dimension."""
    recipes = dims.chord_recipes(df.sparkSession).select(
        F.col("kind").alias("_kind"), F.col("mode").alias("_mode"), F.col("degree").alias("_degree"),
        F.col("chord_type").alias("_type"), F.col("root_shift").alias("_shift"),
    )
    joined = df.join(F.broadcast(recipes), F.col(kind) == F.col("_kind"), "left")
    rooted = joined.withColumn("_root", F.pmod(F.col(root) + F.col("_shift"), F.lit(12)).cast("int"))
    rooted = rooted.withColumn("_mode", pitch.known(F.col("_mode"), F.col(kind), "chord kind"))
    return add_chord(rooted, "_root", "_mode", "_degree", "_type", inversion, name=name).drop(
        "_kind", "_mode", "_degree", "_type", "_shift", "_root"
    )


def progression_chords(root: Column, offsets: Column, degrees: Column) -> Column:
    """Root-position triads of a list of degrees, as an array of note arrays."""

    def triads(table: Column, tonic: Column) -> Column:
        thirds = F.array(F.lit(0), F.lit(2), F.lit(4))
        place = lambda d, step: ((d - 1 + step) % 7 + 1).cast("int")
        return F.transform(
            degrees, lambda d: F.transform(thirds, lambda s: (tonic + F.element_at(table, place(d, s))).cast("int"))
        )

    return let(offsets, lambda table: let(pitch.tonic_note(root), lambda tonic: triads(table, tonic)))


def typed_progression_chords(root: Column, offsets: Column, degrees: Column) -> Column:
    """Like ``progression_chords`` for ``array<struct<degree int, chord_type int>>``."""

    def stacked(table: Column, tonic: Column) -> Column:
        tone = lambda d, i: ((d["degree"] - 1 + i * 2) % 7 + 1).cast("int")
        size = lambda d: F.element_at(literal_map(fv.CHORD_SIZE), d["chord_type"])
        return F.transform(degrees, lambda d: F.transform(
            F.sequence(F.lit(0), size(d) - 1), lambda i: (tonic + F.element_at(table, tone(d, i))).cast("int")
        ))

    return let(offsets, lambda table: let(pitch.tonic_note(root), lambda tonic: stacked(table, tonic)))
