"""Control flow of mainframe programs as tables of blocks and edges, from their lines, by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import COBOL_WORDS, source_lines

FILE = ["repo_id", "path"]
#: Branches that may fall through, ones that never do, and ends of a program (fixed values).
HLASM_BRANCHES = r"(?:BE|BNE|BH|BL|BNH|BNL|BZ|BNZ|BP|BM|BO|BNO|BC|BCT|BXH|BXLE|JE|JNE|JH|JL|JZ|JNZ|JP|JM|JO|BAL|BAS|JAS|BRAS)"
HLASM_JUMPS = r"(?:B|J)"
HLASM_ENDS = r"(?:BR|SVC|RETURN|END)"


def hlasm_blocks(files: DataFrame) -> DataFrame:
    """(repo_id, path, block, first_line, last_line, label, kind, target) of the basic blocks of assembler members.

    A block begins at a label and after a branch. ``kind`` is *branch*, *jump*, *end* or *fall*, by
    its last instruction; ``target`` is the label that a branch or jump names.
    """
    rows = source_lines(files, "hlasm").where(~F.col("text").rlike(r"^\.?\*") & F.col("text").rlike(r"\S"))
    part = lambda n: F.regexp_extract(F.upper("text"), r"^(\S*)\s+(\S+)(?:\s+(\S+))?", n)
    code = rows.select(*FILE, "line", F.nullif(part(1), F.lit("")).alias("label"), part(2).alias("op"), part(3).alias("operand")).where(~F.col("op").isin("DC", "DS", "EQU", "USING", "DROP", "LTORG", "CSECT", "DSECT", "START", "ENTRY", "EXTRN", "COPY", ""))
    kind = F.when(F.col("op").rlike(f"^{HLASM_JUMPS}$"), "jump").when(F.col("op").rlike(f"^{HLASM_BRANCHES}$"), "branch").when(F.col("op").rlike(f"^{HLASM_ENDS}$"), "end")
    order = Window.partitionBy(*FILE).orderBy("line")
    marked = code.withColumn("kind", kind).withColumn("leads", (F.col("label").isNotNull() | F.lag("kind").over(order).isNotNull() | F.lag("line").over(order).isNull()).cast("int"))
    numbered = marked.withColumn("block", F.sum("leads").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.struct("kind", "operand"), "line").alias("last")
    blocks = numbered.groupBy(*FILE, "block").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min_by("label", "line").alias("label"), last)
    target = F.when(F.col("last.kind").isin("branch", "jump"), F.regexp_extract(F.element_at(F.split("last.operand", ","), -1), r"^([A-Z$#@_][A-Z0-9$#@_]*)", 1))
    return blocks.select(*FILE, "block", "first_line", "last_line", "label", F.coalesce("last.kind", F.lit("fall")).alias("kind"), F.nullif(target, F.lit("")).alias("target"))


def block_edges(blocks: DataFrame) -> DataFrame:
    """(repo_id, path, src, dst, kind) between blocks: where each falls through to, and where its branch leads if the label is in the file."""
    order = Window.partitionBy(*FILE).orderBy("block")
    fall = blocks.withColumn("dst", F.lead("block").over(order)).where("kind in ('fall', 'branch') and dst is not null").select(*FILE, F.col("block").alias("src"), "dst", F.lit("fall").alias("kind"))
    labels = blocks.where("label is not null").groupBy(*FILE, "label").agg(F.min("block").alias("dst"))
    led = blocks.where("target is not null").select(*FILE, F.col("block").alias("src"), F.col("target").alias("label"), "kind").join(labels, [*FILE, "label"])
    return fall.unionByName(led.select(*FILE, "src", "dst", "kind"))


def cobol_paragraph_edges(files: DataFrame) -> DataFrame:
    """(repo_id, path, src, dst, kind, line): *fall*, *perform* and *goto* edges between the paragraphs of COBOL programs.

    A paragraph falls through to the next one unless its last statement goes elsewhere or stops.
    Targets that are no paragraph of the program are left out.
    """
    rows = source_lines(files, "cobol").where(~F.col("text").rlike(r"^(.{6}[*/]|\s*\*>)")).withColumn("t", F.upper("text"))
    order = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("in_procedure", F.max(F.col("t").rlike(r"\bPROCEDURE\s+DIVISION\b").cast("int")).over(order)).where("in_procedure = 1")
    name = F.regexp_extract("t", r"^.{7}([A-Z0-9][A-Z0-9-]*)\.\s*$", 1)
    own = F.when((name != "") & ~name.isin(*COBOL_WORDS), name)
    placed = inside.withColumn("paragraph", F.last(own, ignorenulls=True).over(order)).where("paragraph is not null").withColumn("starts", own.isNotNull())
    paragraphs = placed.groupBy(*FILE, "paragraph").agg(F.min("line").alias("line"), F.max_by("t", F.when(~F.col("starts") & F.col("t").rlike(r"\S"), F.col("line"))).alias("last"))
    ordered = Window.partitionBy(*FILE).orderBy("line")
    leaves = F.coalesce(F.col("last").rlike(r"\b(GO\s+TO|GOBACK|STOP\s+RUN|EXIT\s+PROGRAM)\b"), F.lit(False))
    fall = paragraphs.withColumn("dst", F.lead("paragraph").over(ordered)).where(F.col("dst").isNotNull() & ~leaves).select(*FILE, F.col("paragraph").alias("src"), "dst", F.lit("fall").alias("kind"), "line")
    call = lambda kind, pattern: placed.where(F.col("t").rlike(pattern)).select(*FILE, F.col("paragraph").alias("src"), F.regexp_extract("t", pattern, 1).alias("dst"), F.lit(kind).alias("kind"), "line")
    led = call("perform", r"\bPERFORM\s+([A-Z0-9][A-Z0-9-]*)").unionByName(call("goto", r"\bGO\s+TO\s+([A-Z0-9][A-Z0-9-]*)"))
    known = paragraphs.select(*FILE, F.col("paragraph").alias("dst"))
    return fall.unionByName(led.join(known, [*FILE, "dst"], "left_semi"))
