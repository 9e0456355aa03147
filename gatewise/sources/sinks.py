"""Exports: CSV tables, spreadsheets, Gating-ML, HTML and R."""

from __future__ import annotations

import html
import io
import math
import re
import zipfile
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import csv_number, fixed
from ..functions.transforms import inverse_value
from ..model import ALL_EVENTS, Gate, Panel, Transform, dump_gates, tree_order
from ..operators.compensation import Spillover

#: Column orders of the tidy tables.
POPULATION = ["sample", "population", "parent", "depth", "count", "pct_parent", "pct_total", "channel", "median", "mean", "cv"]
TITRATION = ["group", "sample", "concentration", "pct_positive", "mfi_pos", "mfi_neg", "rsd_neg", "stain_index"]
QC = ["group", "sample", "events", "pct_viable", "flow_dev_pct", "offscale_pct", "offscale_channel", "flags"]
SHEET_ROWS, SHEET_COLUMNS = 1_048_575, 16_384
#: Bounds beyond this are written as open.
OPEN_BOUND = 1e9


def events_text(events: DataFrame, panel: Panel) -> DataFrame:
    """Event values with four decimals under their channel names, NA where they aren't finite."""
    return events.select(*[csv_number(F.col(c)).alias(n) for n, c in zip(panel.channels, panel.columns, strict=True)])


def population_table(stats: DataFrame, group: str | None = None) -> DataFrame:
    """Tidy text table of population statistics, with a leading group if there is one."""
    plain = ["population", "parent", "depth", "count", "channel"]
    cols = {"sample": F.col("sample_id"), **{c: F.col(c).cast("string") for c in plain}, **{c: csv_number(F.col(c)) for c in ("pct_parent", "pct_total", "median", "mean", "cv")}}
    return stats.select(*([F.col(group).alias("group")] if group else []), *[cols[c].alias(c) for c in POPULATION])


def titration_table(rows: DataFrame) -> DataFrame:
    figures = TITRATION[2:]
    group = F.col("group") if "group" in rows.columns else F.lit("")
    return rows.select(group.alias("group"), F.col("sample_id").alias("sample"), *[csv_number(F.col(c), missing="" if c == "concentration" else "NA").alias(c) for c in figures])


def qc_table(rows: DataFrame) -> DataFrame:
    group = F.col("group") if "group" in rows.columns else F.lit("")
    two = lambda c: csv_number(F.col(c), 2, "")
    cols = [group, F.col("sample_id"), F.col("n_events").cast("string"), two("viable"), two("flow_dev"), two("offscale_pct"), F.coalesce("offscale_channel", F.lit("")), F.array_join("flags", "; ")]
    return rows.select(*[c.alias(n) for c, n in zip(cols, QC, strict=True)])


def write_csv(table: DataFrame, path: str) -> None:
    """Write as CSV; only fields with a comma or a quote are quoted."""
    table.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def transform_dump(events: DataFrame, raw, shown, label: str = "raw") -> DataFrame:
    return events.select(fixed(raw, 6).alias(label), fixed(shown, 10).alias("transformed"))


def xlsx(header: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet; for result tables, not for events."""
    if len(header) > SHEET_COLUMNS or len(rows) > SHEET_ROWS:
        raise ValueError("a sheet holds 16,384 columns and 1,048,575 rows")

    def cell(v) -> str:
        if isinstance(v, bool) or v is None or isinstance(v, str) or not math.isfinite(v):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("NA" if v is None or isinstance(v, float) else str(v))}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(header), *rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def outline(gate: Gate, segments: int = 64) -> list[tuple[float, float]]:
    """Vertices of a polygon, or of an ellipse as a 64-gon, in display space."""
    s = gate.shape
    if s["shape"] == "polygon":
        return [tuple(v) for v in s["vertices"]]
    turn = [2 * math.pi * i / segments for i in range(segments)]
    cos, sin = math.cos(s["angle"]), math.sin(s["angle"])
    return [(s["cx"] + s["rx"] * math.cos(t) * cos - s["ry"] * math.sin(t) * sin, s["cy"] + s["rx"] * math.cos(t) * sin + s["ry"] * math.sin(t) * cos) for t in turn]


def gate_idents(gates: list[Gate]) -> dict[int, str]:
    """An XML id for each gate, made of its name; a later gate of the same id has its number too."""
    out: dict[int, str] = {}
    for g in gates:
        name = re.sub(r"[^A-Za-z0-9_-]", "_", g.name) or f"gate_{g.id}"
        out[g.id] = f"{name}_{g.id}" if name in out.values() else name
    return out


def gating_ml(gates: list[Gate], spill_channels: Sequence[str] = (), compensated: bool = False) -> tuple[str, list[str]]:
    """(Gating-ML 2.0 document in data space, warnings); bounds beyond 1e9 are left open.

    A dimension refers to the file's own compensation if that is on and has the channel, else to none. Boolean
    gates without a known reference are left out, with a warning.
    """
    ns = 'xmlns:gating="http://www.isac-net.org/std/Gating-ML/v2.0/gating" xmlns:data-type="http://www.isac-net.org/std/Gating-ML/v2.0/datatypes" xmlns:transforms="http://www.isac-net.org/std/Gating-ML/v2.0/transformations"'
    parts, warnings, idents = [], [], gate_idents(gates)
    ident = lambda g: quoteattr(idents[g])

    def dimension(channel: str, lo: float = -math.inf, hi: float = math.inf) -> str:
        bounds = (f' gating:min="{lo!r}"' if lo > -OPEN_BOUND else "") + (f' gating:max="{hi!r}"' if hi < OPEN_BOUND else "")
        source = "FCS" if compensated and channel in spill_channels else "uncompensated"
        return f'<gating:dimension gating:compensation-ref="{source}"{bounds}><data-type:fcs-dimension data-type:name={quoteattr(channel)}/></gating:dimension>'

    for g in gates:
        s, head = g.shape, f"gating:id={ident(g.id)}" + (f" gating:parent_id={ident(g.parent)}" if g.parent in idents else "")
        if g.kind in ("rect", "range"):
            body = dimension(g.x_channel, inverse_value(s["x_min"], g.x_transform), inverse_value(s["x_max"], g.x_transform))
            body += dimension(g.y_channel, inverse_value(s["y_min"], g.y_transform), inverse_value(s["y_max"], g.y_transform)) if g.kind == "rect" else ""
            parts.append(f"<gating:RectangleGate {head}>{body}</gating:RectangleGate>")
        elif g.kind in ("polygon", "ellipse"):
            corners = [(inverse_value(x, g.x_transform), inverse_value(y, g.y_transform)) for x, y in outline(g)]
            points = "".join(f'<gating:vertex><gating:coordinate data-type:value="{x!r}"/><gating:coordinate data-type:value="{y!r}"/></gating:vertex>' for x, y in corners)
            if g.x_transform.kind != "linear" or g.y_transform.kind != "linear":
                warnings.append(f"{g.name}: the {g.kind}'s edges are straight in display space, but written as straight in data space")
            parts.append(f"<gating:PolygonGate {head}>{dimension(g.x_channel)}{dimension(g.y_channel)}{points}</gating:PolygonGate>")
        elif refs := "".join(f"<gating:gateReference gating:ref={ident(r)}/>" for r in s["refs"] if r in idents):
            parts.append(f"<gating:BooleanGate {head}><gating:{s['op']}>{refs}</gating:{s['op']}></gating:BooleanGate>")
        else:
            warnings.append(f"{g.name}: none of its references is known, so it is left out")
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<gating:Gating-ML {ns}>\n' + "\n".join(parts) + "\n</gating:Gating-ML>\n", warnings


def shape_label(shape: dict) -> str:
    """A gate's definition in words."""
    kind, n = shape["shape"], lambda *names: ", ".join(f"{x.replace('_', ' ')} {shape[x]:.4g}" for x in names)
    if kind == "polygon":
        return f"polygon of {len(shape['vertices'])} vertices"
    if kind == "boolean":
        return f"{shape['op'].upper()} of {len(shape['refs'])} gates"
    return f"{kind}: " + {"rect": lambda: n("x_min", "x_max", "y_min", "y_max"), "range": lambda: n("x_min", "x_max"), "ellipse": lambda: n("cx", "cy", "rx", "ry", "angle")}[kind]()


def report_sections(sample: Mapping, panel: Panel, labels: Sequence[str | None], transforms: Mapping[str, Transform], gates: list[Gate], stats: list[Mapping] | None, compensated: bool, spillover: Spillover | None = None, spill_source: str = "") -> dict:
    """The six parts of an analysis report of one tube: sample, channels, compensation, gates, statistics, gate JSON.

    ``sample``: file, events, cytometer, date; ``stats``: rows of ``population_stats`` of this tube.
    """
    dash = "—"
    known = {g.id: g.name for g in gates}
    out: dict = {"Sample": (["", ""], [(k, sample.get(k) or dash) for k in ("file", "events", "cytometer", "date")])}
    out["Channels and transforms"] = (["channel", "stain", "transform"], [(c, s or dash, transforms.get(c, Transform()).label) for c, s in zip(panel.channels, labels, strict=True)])
    if not compensated:
        out["Compensation"] = "Not applied: all figures are of raw data."
    elif spillover is None:
        out["Compensation"] = "Switched on, but there is no spillover matrix."
    else:
        out["Compensation"] = (["spill into", *spillover.channels], [(c, *map(float, r)) for c, r in zip(spillover.channels, spillover.matrix, strict=True)])
        out["Compensation source"] = spill_source or "embedded keyword"
    axes = lambda g: dash if g.kind == "boolean" else " x ".join(f"{c} ({t.label})" for c, t in ((g.x_channel, g.x_transform), (g.y_channel, g.y_transform))[: 1 if g.kind == "range" else 2])
    rows = [("\u00a0\u00a0" * depth + g.name, known.get(g.parent, ALL_EVENTS), axes(g), shape_label(g.shape)) for g, depth in tree_order(gates)]
    out["Gating strategy"] = (["population", "parent", "channels", "definition"], rows) if rows else "No gates."
    if stats:
        channels = list(dict.fromkeys(r["channel"] for r in stats))
        tree = {}
        for r in stats:
            tree.setdefault((r["ord"], r["population"], r["depth"], r["count"], r["pct_parent"], r["pct_total"]), {})[r["channel"]] = r["median"]
        out["Population statistics"] = (["population", "count", "% of parent", "% of total", *(f"median {c}" for c in channels)], [("\u00a0\u00a0" * k[2] + k[1], *k[3:], *(m.get(c) for c in channels)) for k, m in sorted(tree.items(), key=lambda x: x[0][0])])
    else:
        out["Population statistics"] = "None computed."
    return out | {"Gates as JSON": dump_gates(gates)}


def html_report(sections: dict[str, tuple[list[str], list[tuple]] | str], title: str = "Report") -> str:
    """A page of tables (header, rows) and preformatted texts; everything is escaped."""
    e = lambda v: html.escape("NA" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))
    body = []
    for name, part in sections.items():
        body.append(f"<h2>{e(name)}</h2>")
        if isinstance(part, str):
            body.append(f"<pre>{e(part)}</pre>")
        else:
            rows = "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in part[1])
            body.append("<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in part[0]) + f"</tr>{rows}</table>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1>' + "".join(body) + "</body></html>"


def r_script(csv_name: str, groups: Sequence[str], populations: Sequence[str], channel: str | None = None) -> str:
    """R code for a grouped population table: group order, frequencies, descriptives, a plot and a test of one population.

    The test suits the number of groups: none below two, Wilcoxon for two, Kruskal-Wallis for more. A tube is one
    observation: frequencies are taken once for each tube and population, not for each channel.
    """
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    order = f", levels = c({', '.join(map(q, groups))})" if groups else ""
    shown = next((p for p in populations if p.upper() != ALL_EVENTS.upper()), ALL_EVENTS)
    test = "wilcox" if len(groups) == 2 else "kruskal"
    lines = [
        f'd <- read.csv({q(csv_name)}, na.strings = "NA", stringsAsFactors = FALSE)',
        f"d$group <- factor(d$group{order})",
        'share <- d[!duplicated(d[c("group", "sample", "population", "parent", "depth")]), ]',
        'print(tapply(share$sample, share$group, function(s) length(unique(s))))',
        "print(sapply(split(share$pct_parent, list(share$population, share$group)), function(x) c(tubes = length(x), average = mean(x), deviation = sd(x))))",
        f"one <- subset(share, population == {q(shown)})",
        f'stripchart(pct_parent ~ group, data = one, vertical = TRUE, method = "jitter", main = {q(shown)})',
        f"print({test}.test(pct_parent ~ group, data = one))" if len(groups) > 1 else "# no test: fewer than two groups are tagged",
    ]
    if channel:
        lines.append(f"print(with(subset(d, channel == {q(channel)}), tapply(median, list(population, group), mean)))")
    return "\n".join(lines) + "\n"


def r_bundle(stats: DataFrame, path: str, group: str = "group", csv_name: str = "populations.csv") -> str:
    """Write the grouped table of all tubes under ``path``/``csv_name`` and return the script for it.

    Only the distinct group and population names come to the driver.
    """
    names = stats.where(F.col(group) != "").select(group).distinct().orderBy(group)
    pops = stats.groupBy("population").agg(F.min("ord").alias("ord")).orderBy("ord", "population")
    write_csv(population_table(stats, group), f"{path}/{csv_name}")
    return r_script(csv_name, [r[0] for r in names.collect()], [r[0] for r in pops.collect()])


def tsv(table: DataFrame) -> DataFrame:
    """One text column of tab-separated rows, as for a clipboard; nulls are NA."""
    return table.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in table.columns]).alias("value"))


def sheet_rows(stats: DataFrame, group: str | None = None) -> tuple[list[str], list[tuple]]:
    """(header, rows) of population statistics for ``xlsx``: the tidy columns and ``rsd``; for result tables of a sheet's size."""
    figures = [*POPULATION[1:], "rsd"]
    header = [*([group] if group else []), "sample", *figures]
    table = stats.select(*([F.col(group)] if group else []), F.col("sample_id").alias("sample"), *figures, "ord").orderBy("sample", "ord", "channel")
    rows = table.drop("ord").limit(SHEET_ROWS + 1).collect()
    return header, [tuple(r) for r in rows]
