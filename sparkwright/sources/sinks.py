"""Reports and exports: Markdown, graph files, checkpoints."""

from __future__ import annotations

import json
import os
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_rows(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """(file, section): each file's part of the report, its nodes by line, then id."""
    own = nodes.join(summaries.select("node_id", "summary"), "node_id", "left")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("#### "), F.coalesce("type", F.lit("component")), F.lit(" `"), F.coalesce("name", F.lit("unnamed")), F.lit("`\n")),
        F.concat(F.lit("- **Location**: Line "), F.coalesce(F.col("line").cast("string"), F.lit("?"))),
        F.concat(F.lit("- **Complexity**: "), F.col("complexity").cast("string")), F.concat(F.lit("- **LOC**: "), F.col("loc").cast("string")),
        F.concat(F.lit("\n"), F.coalesce("summary", F.lit("No summary available.")), F.lit("\n")), F.lit("---\n"),
    )
    parts = own.select(F.coalesce("file", F.lit("unknown")).alias("file"), F.struct("line", "node_id", body.alias("body")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["body"]), "\n")
    return parts.groupBy("file").agg(F.concat(F.lit("### File: `"), F.first("file"), F.lit("`\n\n"), joined).alias("section"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes and edges."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def write_report(nodes: DataFrame, edges: DataFrame, summaries: DataFrame, path: str) -> None:
    """One Markdown file, written section by section; a file's section is all that the driver holds."""
    n = overview(nodes, edges).first()
    with open(path, "w") as f:
        f.write(f"# Codebase Explanation\n\n## Overview\n\n- **Total Components**: {n['nodes']}\n- **Total Dependencies**: {n['edges']}\n\n\n## Component Details\n\n")
        for row in report_rows(nodes, summaries).orderBy("file").toLocalIterator():
            f.write(row["section"] + "\n")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "graphml") -> bool:
    """graphml, gexf or dot; anything else, and a failure, is told by False. Rows pass through the driver one at a time."""
    if kind not in ("graphml", "gexf", "dot"):
        print(f"unknown graph format: {kind}")
        return False
    try:
        ids = (r[0] for r in nodes.select("node_id").orderBy("node_id").toLocalIterator())
        pairs = ((r[0], r[1], r[2]) for r in edges.select("src", "dst", "type").orderBy("src", "dst").toLocalIterator())
        with open(path, "w") as f:
            if kind == "dot":
                f.write("digraph {\n")
                f.writelines(f"  {json.dumps(i)};\n" for i in ids)
                f.writelines(f"  {json.dumps(a)} -> {json.dumps(b)} [type={json.dumps(t)}];\n" for a, b, t in pairs)
                f.write("}\n")
            elif kind == "graphml":
                f.write('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="edge" attr.name="type" attr.type="string"/><graph edgedefault="directed">\n')
                f.writelines(f"<node id={quoteattr(i)}/>\n" for i in ids)
                f.writelines(f'<edge source={quoteattr(a)} target={quoteattr(b)}><data key="type">{escape(t or "")}</data></edge>\n' for a, b, t in pairs)
                f.write("</graph></graphml>\n")
            else:
                f.write('<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><nodes>\n')
                f.writelines(f"<node id={quoteattr(i)} label={quoteattr(i)}/>\n" for i in ids)
                f.write("</nodes><edges>\n")
                f.writelines(f'<edge id="{n}" source={quoteattr(a)} target={quoteattr(b)} label={quoteattr(t or "")}/>\n' for n, (a, b, t) in enumerate(pairs))
                f.write("</edges></graph></gexf>\n")
    except OSError as e:
        print(f"graph not exported: {e}")
        return False
    return True


def save_checkpoint(summaries: DataFrame, path: str) -> None:
    """A JSON object of all summaries, written beside and then moved into place."""
    with open(f"{path}.part", "w") as f:
        f.write("{")
        for n, row in enumerate(summaries.select("node_id", "summary").orderBy("node_id").toLocalIterator()):
            f.write(("," if n else "") + f"\n{json.dumps(row[0])}: {json.dumps(row[1])}")
        f.write("\n}\n")
    os.replace(f"{path}.part", path)
