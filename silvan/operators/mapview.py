"""Tables behind the map: positions, visibility, lines, colours and the first view."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvan.functions import text as T
from silvan.operators.tree import closure


def positions(points: DataFrame, id_: str = "unit_id", layer: str = "layer") -> DataFrame:
    """id, corpus_id, x, y, z: of several layers that hold an id the last one's counts."""
    last = F.max_by(F.struct("corpus_id", "x", "y", "z"), layer).alias("p")
    return points.groupBy(id_).agg(last).select(id_, "p.*")


def result_positions(results: DataFrame, spans: DataFrame, units: DataFrame) -> DataFrame:
    """results with x, y, z: their span's place, else that of their primary, start or first support unit that has one.

    results: span_id, primary_unit_id, start_unit_id, support_unit_ids; spans: span_id, x, y, z; units: unit_id, x, y, z.
    """
    place = F.struct("x", "y", "z")
    tried = F.concat(F.array("primary_unit_id", "start_unit_id"), F.coalesce("support_unit_ids", F.array().cast("array<bigint>")))
    rows = results.select("span_id", F.posexplode(tried).alias("nth", "unit_id")).join(units.select("unit_id", place.alias("p")), "unit_id")
    nearest = rows.groupBy("span_id").agg(F.min_by("p", "nth").alias("near"))
    out = results.join(spans.select("span_id", place.alias("own")), "span_id", "left").join(nearest, "span_id", "left")
    at = F.coalesce("own", "near")
    return out.select(*(F.col(c) for c in results.columns), *(at[a].alias(a) for a in "xyz"))


def visibility(versions: DataFrame, flags: DataFrame, default: bool = True) -> DataFrame:
    """version_id, visible of the versions of a run: the user's flags where there are some, the default elsewhere; flags of versions that aren't in the run go."""
    return versions.select("version_id").join(flags.select("version_id", "visible"), "version_id", "left").select("version_id", F.coalesce("visible", F.lit(default)).alias("visible"))


def toggled(flags: DataFrame, group: Column) -> DataFrame:
    """version_id, visible with a group switched: hidden if all of it was visible, else visible."""
    every = flags.filter(group).agg(F.bool_and("visible")).first()[0]
    return flags.select("version_id", F.when(group, F.lit(not every)).otherwise(F.col("visible")).alias("visible"))


def solo(flags: DataFrame, group: Column) -> DataFrame:
    """version_id, visible with the group alone visible; if it is so already, all are."""
    alone = flags.filter(F.col("visible") != F.coalesce(group, F.lit(False))).isEmpty()
    return flags.select("version_id", (F.lit(True) if alone else F.coalesce(group, F.lit(False))).alias("visible"))


def depth_range(units: DataFrame) -> DataFrame:
    """low, high: from 0 to the greatest depth of a run, whatever is visible."""
    return units.agg(F.lit(0).alias("low"), F.coalesce(F.max("depth"), F.lit(0)).alias("high"))


def translations(versions: DataFrame, run: DataFrame) -> DataFrame:
    """corpus_id, n: versions of a run (version_id) with a name that isn't blank."""
    named = versions.join(run.select("version_id").distinct(), "version_id", "left_semi").filter(F.coalesce(F.trim("translation"), F.lit("")) != "")
    return named.groupBy("corpus_id").agg(F.count("*").alias("n"))


def constellation(points: DataFrame, order: str) -> DataFrame:
    """x0, y0, z0, x1, y1, z1 and the points' other columns: lines from the first point of a page of results to each other one;
    none for fewer than two."""
    hub = points.orderBy(order).limit(1).collect()
    rows = points.filter(F.col(order) != hub[0][order]) if hub else points.limit(0)
    at = {a: F.lit(hub[0][a] if hub else None).cast("double") for a in "xyz"}
    others = [c for c in points.columns if c not in ("x", "y", "z")]
    return rows.select(*others, *(at[a].alias(f"{a}0") for a in "xyz"), *(F.col(a).alias(f"{a}1") for a in "xyz"))


def chosen_axes(points: DataFrame, x: int, y: int, z: int | None = None, coords: str = "coords") -> DataFrame:
    """points with x, y, z from three of their components (from 0); one that isn't there is 0."""
    of = lambda k: F.coalesce(F.get(coords, F.lit(-1 if k is None else k)), F.lit(0.0))
    return points.withColumns({"x": of(x), "y": of(y), "z": of(z)})


def flat(points: DataFrame) -> DataFrame:
    """points in the plane: z is 0."""
    return points.withColumn("z", F.lit(0.0))


def first_view(bounds: DataFrame, viewport: float, axes: Sequence[str] = ("x", "y"), offset: float = 0.0) -> DataFrame:
    """Centre of each axis and zoom = log2 of seven tenths of the viewport over the widest range (0.1 at least), plus offset."""
    widest = F.greatest(*(F.col(f"{a}_max") - F.col(f"{a}_min") for a in axes), F.lit(0.1))
    centre = [((F.col(f"{a}_min") + F.col(f"{a}_max")) / 2).alias(a) for a in axes]
    return bounds.select(*centre, (F.log2(F.lit(viewport * 0.7) / widest) + offset).alias("zoom"))


def point_radius(bounds: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """radius: a 250th of the widest range (0.1 at least)."""
    return bounds.select((F.greatest(*(F.col(f"{a}_max") - F.col(f"{a}_min") for a in axes), F.lit(0.1)) / 250).alias("radius"))


#: Fill and line of a point without a colour, and of a selected one, with the selected one's alphas: fixed values.
NO_FILL, NO_LINE, SELECTED_FILL, SELECTED_LINE, SELECTED_ALPHAS = (110, 110, 110), (190, 190, 190), (201, 169, 110), (255, 243, 209), (235, 255)


def point_styles(points: DataFrame, colours: DataFrame, visible: DataFrame, selected: DataFrame, alpha: int = 200) -> DataFrame:
    """unit_id, fill, line of each point (unit_id, corpus_id, version_id): four numbers from 0 to 255, the last one 0 if the
    point's version is hidden. colours: corpus_id, fill, line (three numbers each); visible: version_id, visible; selected: unit_id.
    """
    numbers = lambda c: F.array(*map(F.lit, c))
    chosen, shown = F.col("chosen").isNotNull(), F.coalesce("visible", F.lit(True))
    df = points.select("unit_id", "corpus_id", "version_id").join(colours.select("corpus_id", "fill", "line"), "corpus_id", "left")
    df = df.join(visible.select("version_id", "visible"), "version_id", "left").join(selected.select("unit_id", F.lit(True).alias("chosen")).distinct(), "unit_id", "left")

    def style(own: str, missing: tuple, if_chosen: tuple, chosen_alpha: int, plain_alpha: int) -> Column:
        rgb = F.when(chosen, numbers(if_chosen)).otherwise(F.coalesce(own, numbers(missing)))
        return F.concat(rgb, F.array(F.when(~shown, 0).when(chosen, chosen_alpha).otherwise(plain_alpha))).alias(own)

    fill = style("fill", NO_FILL, SELECTED_FILL, SELECTED_ALPHAS[0], alpha)
    return df.select("unit_id", fill, style("line", NO_LINE, SELECTED_LINE, SELECTED_ALPHAS[1], min(240, alpha + 25)))


#: Hue, saturation and lightness of taxonomy nodes by their names in small letters: fixed values.
PALETTE = {
    "abrahamic": (214, 55, 46),
    "indic (dharmic)": (38, 76, 45),
    "east asian": (195, 48, 38),
    "persian": (348, 58, 46),
    "indigenous": (164, 32, 38),
    "ancient / historical": (24, 24, 50),
    "new religious movements": (316, 42, 45),
    "other (sacred)": (42, 48, 43),
    "non sacred": (207, 16, 38),
    "judaism": (211, 62, 47),
    "christianity": (229, 52, 50),
    "islam": (174, 52, 38),
    "sikhism": (28, 82, 46),
    "buddhism": (47, 78, 45),
    "jainism": (83, 42, 39),
    "hinduism": (16, 70, 48),
    "taoism": (195, 52, 36),
    "confucianism": (210, 44, 40),
    "shinto": (5, 55, 47),
    "zen": (180, 38, 37),
    "zoroastrianism": (348, 62, 44),
    "north american": (172, 34, 38),
    "mesoamerican": (135, 35, 39),
    "south american": (93, 38, 38),
    "african": (24, 43, 40),
    "oceanian": (196, 43, 40),
    "aboriginal australian": (9, 45, 42),
    "greek": (260, 38, 49),
    "roman": (286, 32, 46),
    "egyptian": (50, 52, 42),
    "mesopotamian": (336, 45, 43),
    "norse / germanic": (204, 38, 42),
    "celtic": (142, 35, 39),
    "scientology": (309, 43, 45),
    "bahá'í": (326, 43, 45),
    "bahai": (326, 43, 45),
    "neo-paganism / wicca": (283, 36, 44),
    "other modern movements": (336, 35, 44),
    "philosophy": (216, 18, 39),
    "scientific": (188, 22, 38),
    "literature": (258, 18, 42),
    "plays": (300, 18, 41),
    "speeches": (226, 22, 42),
    "historical": (25, 24, 39),
}
#: Colours of corpora that don't follow from their taxonomy, and the colour of what has none: fixed values.
CORPUS_COLOURS = {"old testament": (207, 50, 45)}
NO_COLOUR = (0, 0, 43)


def _hsl(of: tuple[int, int, int]) -> Column:
    return F.struct(*(F.lit(v).alias(n) for v, n in zip(of, "hsl", strict=True)))


def _listed(name: Column, colours: dict[str, tuple[int, int, int]]) -> Column:
    """The colour that a table of fixed values has for a name, else null."""
    table = F.create_map(*(c for k, v in colours.items() for c in (F.lit(k), _hsl(v))))
    return F.try_element_at(table, F.lower(F.trim(name)))


def node_colours(taxonomy: DataFrame) -> DataFrame:
    """taxonomy with colour (struct of h, s, l): the palette's, else one near the colour of what has none, by the name."""
    near = variant(F.col("name"), "taxonomy", *(F.lit(v) for v in NO_COLOUR))
    return taxonomy.withColumn("colour", F.coalesce(_listed(F.col("name"), PALETTE), near))


def corpus_colours(corpora: DataFrame, links: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """corpus_id, colour of corpora (corpus_id, name): one set for the corpus, else one near the colour of the deepest node above
    a link of it (of several, the one that comes first by id); NO_COLOUR for a corpus without links, near no colour for one without a name."""
    up = closure(taxonomy).select(F.col("descendant").alias("taxonomy_id"), F.col("ancestor").alias("id"))
    nodes = links.join(up, "taxonomy_id").join(node_colours(taxonomy).select("id", "level", "colour"), "id")
    deepest = nodes.groupBy("corpus_id").agg(F.min_by("colour", F.struct((-F.col("level")).alias("up"), F.col("id"))).alias("base"))
    own = variant(F.col("name"), "corpus", *(F.col("base")[c] for c in "hsl"))
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    colour = F.when(F.col("base").isNull(), _hsl(NO_COLOUR)).when(~named, F.col("base")).otherwise(F.coalesce(_listed(F.col("name"), CORPUS_COLOURS), own))
    return corpora.select("corpus_id", "name").join(deepest, "corpus_id", "left").select("corpus_id", colour.alias("colour"))


#: Fixed values. Shifts of hue, saturation and lightness by a name's hash: (modulus, bits shifted away) of each and the ranges that the last two stay in.
VARIANTS = {
    "corpus": ((11, 0), (13, 5), (21, 9), (28, 90), (28, 68)),
    "translation": ((7, 0), (7, 5), (13, 8), (28, 92), (26, 74)),
    "taxonomy": ((25, 0), (11, 5), (15, 9), (24, 86), (28, 68)),
}


def variant(name: Column, kind: str, hue: Column, saturation: Column, lightness: Column) -> Column:
    """struct<h, s, l>: the colour of a name near a base colour; the same name always gets the same."""
    code = T.name_hash(F.lower(F.trim(name)))
    (hm, hs), (sm, ss), (lm, ls), s_range, l_range = VARIANTS[kind]
    shift = lambda modulus, bits: F.pmod(F.shiftright(code, bits), F.lit(modulus)) - modulus // 2
    clamp = lambda v, r: F.greatest(F.lit(r[0]), F.least(F.lit(r[1]), v))
    return F.struct(F.pmod(hue + shift(hm, hs) + 360, F.lit(360)).alias("h"), clamp(saturation + shift(sm, ss), s_range).alias("s"), clamp(lightness + shift(lm, ls), l_range).alias("l"))


def rgb(h: float, s: float, l: float) -> tuple[int, int, int]:  # noqa: E741
    """Red, green and blue (0 to 255) of hue in degrees, saturation and lightness in percent."""
    s, l = s / 100, l / 100  # noqa: E741
    a = s * min(l, 1 - l)
    of = lambda n: l - a * max(-1, min((n + h / 30) % 12 - 3, 9 - (n + h / 30) % 12, 1))
    return tuple(math.floor(255 * of(n) + 0.5) for n in (0, 8, 4))
