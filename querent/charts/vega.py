"""Vega-Lite specifications from a VISUALISE clause and a query's rows."""

from __future__ import annotations

import datetime
import json
import math
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from querent.charts import stats
from querent.errors import InvalidQuery, QueryError
from querent.lang import tree as t

SCHEMA = "https://vega.github.io/schema/vega-lite/v6.json"
MAX_ROWS = 100_000

# fixed values: names of marks, channels, scales and map projections
MARKS = {
    "point": "point", "line": "line", "path": "line", "bar": "bar", "area": "area", "tile": "rect", "polygon": "line", "ribbon": "area", "histogram": "bar",
    "density": "area", "violin": "line", "boxplot": "boxplot", "text": "text", "segment": "rule", "smooth": "line", "rule": "rule", "range": "rule", "spatial": "geoshape",
}
ALIASES = {"colour": "color", "label": "text", "linewidth": "strokeWidth", "linetype": "strokeDash", "fontsize": "size", "lon": "longitude", "lat": "latitude", "xend": "x2", "yend": "y2", "xmin": "x", "xmax": "x2", "ymin": "y", "ymax": "y2"}
WILDCARD = ("x", "y", "color", "fill", "size", "shape", "opacity", "theta", "radius", "text", "detail", "tooltip")
POSITIONAL = frozenset({"x", "y", "x2", "y2", "theta", "theta2", "radius", "radius2", "latitude", "longitude"})
PROJECTIONS = {
    "crs": "equalEarth", "map": "equalEarth", "geographic": "equirectangular", "equirectangular": "equirectangular", "mercator": "mercator", "transverse_mercator": "transverseMercator",
    "utm": "transverseMercator", "orthographic": "orthographic", "stereographic": "stereographic", "gnomonic": "gnomonic", "albers": "albers", "equal_area": "conicEqualArea",
    "lambert_conformal": "conicConformal", "lambert": "azimuthalEqualArea", "azimuthal_equidistant": "azimuthalEquidistant", "natural": "naturalEarth1", "equal_earth": "equalEarth",
    "miller": "miller", "mollweide": "mollweide", "sinusoidal": "sinusoidal", "eckert4": "eckert4", "winkel_tripel": "winkel3", "robinson": "robinson", "igh": "interruptedHomolosine",
}
TRANSFORMS = {"log": ("log", None), "log10": ("log", 10), "log2": ("log", 2), "ln": ("log", math.e), "sqrt": ("sqrt", None), "square": ("pow", 2), "symlog": ("symlog", None), "pow": ("pow", None), "linear": ("linear", None), "identity": ("linear", None)}
TEMPORAL_VIA = ("date", "datetime", "time", "timestamp")
BASEMAP = "/geo/countries-110m.json"
STATISTICS = ("histogram", "boxplot", "heatmap", "smooth", "density", "violin")


class ChartError(Exception):
    pass


@dataclass
class OutputColumn:
    name: str
    family: str | None
    label: str | None = None
    title: str | None = None
    unit: str | None = None
    grain: str | None = None
    dimension: Any = None
    direction: str | None = None

    @property
    def kind(self) -> str:
        if self.family in ("INTEGER", "DECIMAL", "FLOAT"):
            return "quantitative"
        return "temporal" if self.family in ("DATE", "TIMESTAMP") else "nominal"


@dataclass
class Source:
    """Columns and rows that a layer draws."""

    columns: dict[str, OutputColumn]
    rows: list[dict] = field(default_factory=list)


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (str, int, float, bool)) else str(x)


#: position settings and how they stack
POSITIONS = {"identity": None, "dodge": None, "stack": "zero", "fill": "normalize"}
#: what the two places of a plane are called, by coordinate system
PLANES = {"polar": {"x": "radius", "y": "theta"}, "map": {"x": "longitude", "y": "latitude"}}


def plane(projection: t.Projection | None) -> dict[str, str]:
    """Names of channels under a coordinate system."""
    if projection is None:
        return {}
    if projection.system == "cartesian":
        return dict(zip(projection.aesthetics, "xy")) if len(projection.aesthetics) > 1 else {}
    return PLANES.get("map" if is_map(projection) else projection.system, {})


def channel_name(name: str, projection: t.Projection | None) -> str:
    """A channel's name in the specification."""
    names, usual = plane(projection), ALIASES.get(name, name)
    return names.get(name) or names.get(usual) or usual


def map_name(system: str) -> str | None:
    return PROJECTIONS.get(system) or (system if system in PROJECTIONS.values() else None)


def is_map(projection: t.Projection | None) -> bool:
    return projection is not None and map_name(projection.system) is not None


class Emitter:
    def __init__(self, chart: t.Chart, source: Source, results: dict[int, Source] | None = None):
        self.chart, self.source, self.results = chart, source, results or {}
        self.projection = chart.projection
        if self.projection is None and any(x.mark == "spatial" for x in chart.layers):
            self.projection = t.Projection((), "equal_earth")
        if self.projection is not None and self.projection.system not in ("polar", "cartesian") and not is_map(self.projection):
            raise ChartError(f"unknown coordinate system {self.projection.system}")
        if is_map(self.projection) and any(k == "target" for k, _ in self.projection.settings):
            raise ChartError("a map cannot be drawn in another target CRS; name its projection")
        self.scales = {channel_name(s.channel, self.projection): s for s in chart.scales}
        self.labels = {channel_name(k, self.projection): v for k, v in chart.labels}

    # mappings

    def mappings(self, layer: t.Layer) -> dict[str, t.Mapping]:
        out: dict[str, t.Mapping] = {}
        for m in (*self.chart.mappings, *layer.mappings):
            if m.channel == "*":
                for name in self.source.columns:
                    if name in WILDCARD:
                        out.setdefault(name, t.Mapping(name, name))
            else:
                out[m.channel] = m
        for m in out.values():
            if not m.literal and m.value not in self.source.columns and id(layer) not in self.results:
                raise ChartError(f"VISUALISE names {m.value}, which is no output column")
        return out

    # encodings

    def encoding(self, layer: t.Layer, source: Source, mappings: dict[str, t.Mapping]) -> dict:
        out: dict[str, Any] = {}
        for name, m in mappings.items():
            if layer.mark == "spatial" and name == "geometry":
                continue
            channel = channel_name(name, self.projection)
            if m.literal:
                out[channel] = {"datum" if channel in POSITIONAL else "value": m.value}
            else:
                out[channel] = self.field(channel, source.columns[m.value], source, mappings)
        return out

    def field(self, channel: str, column: OutputColumn, source: Source, mappings: dict[str, t.Mapping]) -> dict:
        out: dict[str, Any] = {"field": column.name}
        if channel in ("longitude", "latitude"):
            return out
        kind, scale = column.kind, self.scales.get(channel)
        if scale is not None and scale.kind == "ORDINAL":
            kind = "ordinal"
        elif scale is not None and scale.kind == "DISCRETE":
            kind = "nominal"
        elif scale is not None and scale.kind in ("CONTINUOUS", "BINNED") and kind != "temporal":
            kind = "quantitative"
        if scale is not None and scale.transform in TEMPORAL_VIA:
            kind = "temporal"
        if channel not in ("x2", "y2", "theta2", "radius2"):
            out["type"] = kind
        title = self.labels[channel] if channel in self.labels else self.title(column)
        if title is not None or channel in self.labels:
            out["title"] = title
        if kind == "temporal" and column.grain and channel in ("x", "y"):
            formats = {"year": "%Y", "quarter": "%Y-%m", "month": "%Y-%m", "day": "%Y-%m-%d", "hour": "%Y-%m-%d %H:00"}
            if column.grain in formats:
                out["axis"] = {"format": formats[column.grain]}
        if kind in ("nominal", "ordinal") and channel in ("x", "y"):
            order = self.order(column, source, mappings)
            if order is not None:
                out["sort"] = order
        if scale is not None:
            self.scaled(out, channel, scale)
        return out

    def title(self, column: OutputColumn) -> str | None:
        text = column.title or column.label
        if text is None:
            return None
        return f"{text} ({column.unit})" if column.unit else text

    def order(self, column: OutputColumn, source: Source, mappings: dict[str, t.Mapping]):
        """The query's order of rows, for a discrete axis."""
        if column.direction:
            return "ascending" if column.direction == "ASC" else "descending"
        for m in mappings.values():
            other = source.columns.get(m.value) if not m.literal else None
            if other is not None and other.direction and other.kind == "quantitative":
                return {"field": other.name, "op": "sum", "order": "ascending" if other.direction == "ASC" else "descending"}
        return None

    def scaled(self, out: dict, channel: str, s: t.Scale) -> None:
        scale: dict[str, Any] = {}
        settings = dict(s.settings)
        if s.transform is not None and s.transform not in TEMPORAL_VIA:
            if s.transform not in TRANSFORMS:
                raise ChartError(f"unknown scale transformation {s.transform}")
            scale["type"], base = TRANSFORMS[s.transform]
            if base is not None:
                scale["exponent" if scale["type"] == "pow" else "base"] = base
        if s.kind == "IDENTITY":
            out["scale"] = None
            return
        if s.kind == "BINNED":
            out["bin"] = {"maxbins": settings["bins"]} if "bins" in settings else True
        if s.domain is not None:
            scale["domain"] = list(s.domain)
        if s.range is not None:
            scale["scheme" if isinstance(s.range, str) else "range"] = s.range if isinstance(s.range, str) else list(s.range)
        if settings.get("reverse") in (True, "true"):
            scale["reverse"] = True
        if scale:
            out["scale"] = scale
        guide = out.setdefault("axis" if channel in ("x", "y") else "legend", {})
        if "breaks" in settings:
            breaks = settings["breaks"]
            if isinstance(breaks, tuple):
                guide["values"] = list(breaks)
            elif isinstance(breaks, (int, float)) and not isinstance(breaks, bool):
                guide["tickCount"] = breaks
            else:
                raise ChartError("breaks is a number of ticks or an array of places")
        if s.renaming:
            if any(k == "*" for k, _ in s.renaming):
                raise ChartError("RENAMING of the wildcard * is not possible")
            expression = "datum.label"
            for k, v in reversed(s.renaming):
                expression = f"datum.value == {json.dumps(k)} ? {json.dumps(v or '')} : {expression}"
            guide["labelExpr"] = expression
        if not guide:
            del out["axis" if channel in ("x", "y") else "legend"]

    # layers

    def layer(self, layer: t.Layer) -> list[dict]:
        if layer.mark not in MARKS and layer.mark != "heatmap":
            raise ChartError(f"unknown mark {layer.mark}")
        if layer.placed:
            return [self.placed(layer)]
        settings = dict(layer.settings)
        if settings.get("position") == "jitter":
            raise ChartError("position jitter is not available")
        mappings = self.mappings(layer)
        if id(layer) in self.results:
            return self.statistic(layer, mappings)
        if layer.mark == "spatial":
            return [self.spatial(layer, mappings)]
        encoding = self.encoding(layer, self.source, mappings)
        for m in layer.remappings:
            encoding[channel_name(m.channel, self.projection)] = {"value": m.value} if m.literal else self.field(m.channel, self.source.columns[m.value], self.source, mappings)
        self.position(settings.get("position"), encoding)
        return [{"mark": self.mark(MARKS[layer.mark], settings), "encoding": encoding}]

    def mark(self, kind: str, settings: dict) -> dict:
        out: dict[str, Any] = {"type": kind}
        if self.projection is not None and self.projection.system == "polar" and kind == "bar":
            out["type"] = "arc"
            inner = dict(self.projection.settings).get("inner")
            if inner:
                out["innerRadius"] = int(round(float(inner) * 100))
        skip = {"position", "aggregate", "bins", "binwidth", "points", "method"}
        out |= {ALIASES.get(k, k): list(v) if isinstance(v, tuple) else v for k, v in settings.items() if k not in skip}
        return out

    def position(self, how: str | None, encoding: dict) -> None:
        if how is not None and how not in POSITIONS:
            raise ChartError(f"unknown position {how}")
        value = next((c for c in ("y", "x") if encoding.get(c, {}).get("type") == "quantitative"), "y")
        if how in (None, "identity") or value not in encoding:
            return
        encoding[value]["stack"] = POSITIONS[how]
        group = encoding.get("color") or encoding.get("fill")
        if how == "dodge" and group and "field" in group:
            encoding["xOffset" if value == "y" else "yOffset"] = {"field": group["field"], "type": "nominal"}

    def placed(self, layer: t.Layer) -> dict:
        encoding: dict[str, Any] = {}
        for k, v in layer.settings:
            if isinstance(v, tuple):
                raise ChartError(f"PLACE takes no array for {k}")
            channel = channel_name(k, self.projection)
            encoding[channel] = {"datum" if channel in POSITIONAL else "value": v}
        return {"data": {"values": [{}]}, "mark": {"type": MARKS[layer.mark]}, "encoding": encoding}

    def spatial(self, layer: t.Layer, mappings: dict[str, t.Mapping]) -> dict:
        if "geometry" not in mappings or mappings["geometry"].literal:
            raise ChartError("DRAW spatial needs a column mapped to geometry")
        name = mappings["geometry"].value
        features = []
        for r in self.source.rows:
            if r[name] is None:
                continue
            features.append({"type": "Feature", "geometry": json.loads(r[name]), **{k: plain(v) for k, v in r.items() if k != name}})
        return {"data": {"values": features}, "mark": self.mark("geoshape", dict(layer.settings)), "encoding": self.encoding(layer, self.source, mappings)}

    def statistic(self, layer: t.Layer, mappings: dict[str, t.Mapping]) -> list[dict]:
        source, mark = self.results[id(layer)], layer.mark
        data = {"values": [{k: plain(v) for k, v in r.items()} for r in source.rows]}
        number = lambda n: {"field": n, "type": "quantitative"}
        of = lambda c: mappings[c].value if c in mappings else None
        titled = lambda e, title: e | {"title": title}
        settings = dict(layer.settings)
        group = {"field": "group", "type": "nominal", "title": of("x")}
        if mark == "histogram":
            encoding = {"x": titled(number("bin_start"), of("x")) | {"bin": {"binned": True}}, "x2": {"field": "bin_end"}, "y": titled(number("bin_count"), "count")}
            parts = [("bar", encoding)]
        elif mark == "boxplot":
            key = {"x": group} if of("x") else {}
            parts = [("rule", key | {"y": titled(number("lower"), of("y")), "y2": {"field": "upper"}}), ("bar", key | {"y": titled(number("q1"), of("y")), "y2": {"field": "q3"}}), ("tick", key | {"y": titled(number("median"), of("y"))})]
        elif mark in ("tile", "heatmap"):
            parts = [("rect", {"x": titled(number("x"), of("x")) | {"bin": {"binned": True}}, "x2": {"field": "x2"}, "y": titled(number("y"), of("y")) | {"bin": {"binned": True}}, "y2": {"field": "y2"}, "color": number("count")})]
        elif mark == "smooth":
            parts = [("line", {"x": titled(number("x"), of("x")), "y": titled(number("y"), of("y"))})]
        elif mark == "density":
            parts = [("area", {"x": titled(number("x"), of("x")), "y": number("density")})]
        elif mark == "violin":
            parts = [("line", {"x": titled(number("value"), of("y")), "y": number("density")} | ({"color": group} if of("x") else {}))]
        else:  # an aggregate keeps the columns' names
            encoding = self.encoding(layer, source, mappings)
            self.position(settings.get("position"), encoding)
            parts = [(MARKS[mark], encoding)]
        return [{"data": data, "mark": self.mark(kind, settings if kind == MARKS.get(mark) else {}), "encoding": e} for kind, e in parts]

    # the whole

    def spec(self) -> dict:
        chart = self.chart
        layers = [x for layer in (chart.layers or (t.Layer("point"),)) for x in self.layer(layer)]
        out: dict[str, Any] = {"$schema": SCHEMA}
        for k in ("title", "subtitle"):
            if k in self.labels:
                out["title"] = self.labels[k] if k == "title" else {"text": out.get("title"), "subtitle": self.labels[k]}
        if any("data" not in x for x in layers):
            out["data"] = {"values": [{k: plain(v) for k, v in r.items()} for r in self.source.rows]}
        if is_map(self.projection):
            settings = dict(self.projection.settings)
            projection: dict[str, Any] = {"type": map_name(self.projection.system)}
            if "origin" in settings:
                projection["rotate"] = [-float(v) for v in settings["origin"]]
            if "parallel" in settings:
                projection["parallels"] = [float(v) for v in settings["parallel"]]
            out["projection"] = projection
            layers = self.backgrounds(settings) + layers
        resolve: dict[str, Any] = {}
        if len(layers) == 1:
            body = layers[0]
        else:
            body = {"layer": layers}
            if self.apart(layers):
                resolve["y"] = "independent"
        if chart.facet is not None:
            f = chart.facet
            settings = dict(f.settings)
            for n in (*f.rows, *f.columns):
                if n not in self.source.columns:
                    raise ChartError(f"FACET names {n}, which is no output column")
            by = lambda n: {"field": n, "type": "nominal" if self.source.columns[n].kind == "quantitative" else self.source.columns[n].kind}
            out["facet"] = {"row": by(f.rows[0]), "column": by(f.columns[0])} if f.columns else by(f.rows[0])
            if "ncol" in settings:
                out["columns"] = settings["ncol"]
            free = settings.get("free")
            for c in free if isinstance(free, tuple) else (free,) if free else ():
                for axis in ("x", "y") if c in ("both", "xy") else (c,):
                    resolve[axis] = "independent"
            out["spec"] = body
        else:
            out |= body
        if resolve:
            out["resolve"] = {"scale": resolve}
        return out

    def apart(self, layers: list[dict]) -> bool:
        """Whether layers measure different things on y."""
        found = set()
        for x in layers:
            y = x["encoding"].get("y", {})
            c = self.source.columns.get(y.get("field"))
            if c is not None and c.dimension is not None and "data" not in x:
                found.add(c.dimension)
        return len(found) > 1

    def backgrounds(self, settings: dict) -> list[dict]:
        off = lambda k: settings.get(k) in (False, "false", "none", "off")
        if any(x.mark == "spatial" for x in self.chart.layers):
            return []
        out = []
        if not off("sphere"):
            out.append({"data": {"sphere": True}, "mark": {"type": "geoshape", "fill": "#f5f8fa"}, "encoding": {}})
        if not off("graticule"):
            out.append({"data": {"graticule": True}, "mark": {"type": "geoshape", "filled": False, "stroke": "#dddddd"}, "encoding": {}})
        if not off("basemap"):
            url = settings.get("basemap")
            out.append({"data": {"url": url if isinstance(url, str) and url not in ("true", "on") else BASEMAP, "format": {"type": "topojson", "feature": "countries"}}, "mark": {"type": "geoshape", "fill": "#e6e6e6", "stroke": "white"}, "encoding": {}})
        return out


def columns_of(analysis, typing) -> dict[str, OutputColumn]:
    from querent.insight.findings import findings
    from querent.insight.quantity import UNITS

    out = {}
    for f in findings(analysis, typing):
        symbol = UNITS[f.quantity.unit].symbol if f.quantity.unit in UNITS else None
        out[f.header] = OutputColumn(f.header, f.type.family, f.label, f.title, symbol or None, f.grain, f.quantity.dims if f.quantity.known else None, f.direction)
    return out


def wanted(layer: t.Layer) -> str | None:
    """The statistic of a layer, if it has one."""
    if layer.placed:
        return None
    settings = dict(layer.settings)
    if "aggregate" in settings:
        return "aggregate"
    if layer.mark == "tile" and "bins" in settings:
        return "heatmap"
    return layer.mark if layer.mark in STATISTICS else None


def drawn(df) -> list[dict]:
    """The rows that a layer draws."""
    rows = [r.asDict() for r in df.limit(MAX_ROWS + 1).collect()]
    if len(rows) > MAX_ROWS:
        raise ChartError(f"a chart draws at most {MAX_ROWS} rows; aggregate them or use a statistic")
    return rows


def computed(layer: t.Layer, mappings: dict[str, t.Mapping], df, columns: dict[str, OutputColumn]) -> Source:
    """Runs a layer's statistic."""
    settings = dict(layer.settings)
    col = lambda c: mappings[c].value if c in mappings and not mappings[c].literal else None

    def need(c: str) -> str:
        if col(c) is None:
            raise ChartError(f"{layer.mark} needs a column mapped to {c}")
        return col(c)

    kind = wanted(layer)
    if kind == "histogram":
        out = stats.histogram(df, need("x"), settings.get("bins"), settings.get("binwidth"))
    elif kind == "boxplot":
        out = stats.boxplot(df, need("y"), col("x"))
    elif kind == "heatmap":
        out = stats.heatmap(df, need("x"), need("y"), settings.get("bins"), settings.get("ybins"))
    elif kind == "smooth":
        out = stats.smooth(df, need("x"), need("y"), settings.get("method"))
    elif kind == "density":
        out = stats.density(df, need("x"), settings.get("points"))
    elif kind == "violin":
        out = stats.violin(df, need("y"), col("x"), settings.get("points"))
    else:
        groups = list(dict.fromkeys(m.value for c, m in mappings.items() if not m.literal and c != "y"))
        out = stats.aggregate(df, need("y"), settings["aggregate"], groups)
    kept = {n: columns[n] for n in out.columns if n in columns}
    return Source(kept, drawn(out))


def render(analysis, typing, df) -> str:
    """The specification with its data; statistics share one stored copy of the query's rows."""
    from querent.sources.store import stored

    chart, columns = analysis.query.chart, columns_of(analysis, typing)
    probe = Emitter(chart, Source(columns), {id(x): Source(columns) for x in chart.layers if wanted(x)})
    layers = chart.layers or (t.Layer("point"),)
    with_statistic = [x for x in layers if wanted(x)]
    if len(layers) > 1 and with_statistic:
        df = stored(df)
    results = {id(x): computed(x, probe.mappings(x), df, columns) for x in with_statistic}
    rows: list[dict] = []
    if any(not wanted(x) and not x.placed for x in layers):
        rows = drawn(df)
    return json.dumps(Emitter(chart, Source(columns, rows), results).spec(), ensure_ascii=False)


@dataclass
class RenderResult:
    """What rendering without data says: an error, violations, or a structural specification."""

    spec: str | None = None
    violations: list = field(default_factory=list)
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None and not self.violations


def checked(engine, text: str, values: dict | None = None) -> RenderResult:
    try:
        a, types = engine.analyse(text, values)
        if a.violations:
            return RenderResult(violations=list(a.violations))
        if a.query.chart is None:
            return RenderResult()
        columns = columns_of(a, types)
        empty = {id(x): Source(columns) for x in a.query.chart.layers if wanted(x)}
        return RenderResult(json.dumps(Emitter(a.query.chart, Source(columns), empty).spec(), ensure_ascii=False))
    except (QueryError, InvalidQuery, ChartError, stats.StatError) as e:
        return RenderResult(error=str(e))
