"""The markup grammars over generated rows: every rule on every row of ``part``, with the result each must have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import anchors, names, rules
from loomdoc.operators import pages
from loomdoc.plans.cases import Cases, inputs, wanted
from loomdoc.plans.registry import query


def outputs(spark: SparkSession, sf_dir: str, cases: Cases, of) -> DataFrame:
    return inputs(spark, sf_dir, cases).select("p_partkey", "rule", of(F.col("input")).alias("output"))


INLINE: Cases = {
    "lone pipe at the end": ("«first» ''«second»''  | ", "«first» *«second»*"),
    "pipes of a row": ("| «first» |", "| «first» |"),
    "quoted delimiter": ("set ''''«first»'''' to «key»", "set `«first»` to «key»"),
    "bold": ("a '''«name»''' b", "a **«name»** b"),
    "bold, spaces inside": ("a ''' «name» ''' b", "a  **«name»**  b"),
    "bold, double quotes": ('"""«kind»""" of «name»', "**«kind»** of «name»"),
    "bold, never closed": ("see '''«name»", "see **«name»**"),
    "italic": ("a ''«name»'' b", "a *«name»* b"),
    "bold italic": ("'''''«name»'''''", "***«name»***"),
    "comment anchor": ("«name»[[#comment«key»|x]] b", "«name» b"),
    "anchor": ("«name» [[#«first»]]", "«name» "),
    "labelled link": ("the [[https://«first».example/«key»|«name»]] page", "the [«name»](https://«first».example/«key») page"),
    "label with code": ("[[https://«first».example/|@@«second»@@]]", "[`«second»`](https://«first».example/)"),
    "bare link": ("at [[https://«first».example/«key»]].", "at [https://«first».example/«key»](https://«first».example/«key»)."),
    "inserted": ("{+«name»+} and «kind»", "«name» and «kind»"),
    "deleted": ("{-«name»-} and «kind»", "«name» and «kind»"),
    "inline code": ("run [@«first» «key»@] now", "run `«first» «key»` now"),
    "monospace": ("run @@«first» «key»@@ now", "run `«first» «key»` now"),
    "monospace, one mark lost": ("run @@«first»@ now", "run `«first»` now"),
    "hex colour": ("%color=#ff0000%«name»%% b", "@@red|«name»@@ b"),
    "colour": ("a %blue%«name»%% b", "a @@blue|«name»@@ b"),
    "colour, reset by another": ("%green%«name»%black% b", "@@green|«name»@@ b"),
    "colour around code": ("%red%$«first» x%%", "`@@red|$«first» x@@`"),
    "style": ("%center% «name»", " «name»"),
    "style with a value": ("%width=«key»px% «name»", " «name»"),
    "printf is no style": ("log.%e.%t of «name»", "log.%e.%t of «name»"),
    "image": ("https://x.example/a/«first»_«second».png", "![«first» «second»](/images/docs/tutorials/«first»_«second».png)"),
    "page variable": ("{$Title}«name»", "«name»"),
    "directive": ("(:toc:)«name»", "«name»"),
    "division mark": (">>note<<«name»", "«name»"),
    "big text": ("[++«name»++]", "«name»"),
    "break at the end": ("«name»\\\\", "«name»  "),
    "variable": ("set $«first»(«second»)[«key»] now", "set `$«first»(«second»)[«key»]` now"),
    "nested variable": ("set $(«first»(«second»){s.len}) now", "set `$(«first»(«second»){s.len})` now"),
    "braces": ("the {«first».len} of «name»", "the `{«first».len}` of «name»"),
    "empty braces": ("the «first»{} of «name»", "the «first»\\{\\} of «name»"),
    "arrows": ("«first»<->«second», «first»<-«second»", "«first»↔«second», «first»←«second»"),
    "mail address stays": ("«first»@«second».example today", "«first»@«second».example today"),
}


@query("wiki_inline", wanted(INLINE))
def wiki_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs(spark, sf_dir, INLINE, pages.wiki_inline)


BLOCKS: Cases = {
    "false conditional": ("! «name»\n(:if false:)\ngone\n(:ifend:)\n«first»", "## «name»\n\n«first»"),
    "breadcrumb": ("!!!!!Docs -> Guide -> «name»\n! «kind»", "## «kind»"),
    "deleted code": ("{-[@\n«first» «key»\n@]-}", '```text del="1-1"\n«first» «key»\n```'),
    "code": ("[@\n«name»\n  «key»\n@]", "```text\n«name»\n  «key»\n```"),
    "code of a language": ("[@\nSELECT «first» FROM «second»\n@]", "```sql\nSELECT «first» FROM «second»\n```"),
    "frame": (">>lframe black<<\n«first»[=:=]«second»[[<<]]\n_empty_line_\n>><<", "```text\n«first»:«second»\n```"),
    "frame with colours": (">>frame<<\n%red%«name»%%\n>><<\nend", "> [!IMPORTANT]\n> «name»\n\nend"),
    "comment": ("«name»\n(:comment «kind»:)\n«key»", "«name»\n«key»"),
    "admonition": (">>tip<<\n«name»\n>><<", "> [!TIP]\n> «name»"),
    "indented": (" «first» «key»\n «second»", "```text\n«first» «key»\n«second»\n```"),
    "indented numbers": ("   1 - a «first».\n   2 - a «second».", "1. a «first».\n2. a «second»."),
    "table": ("|| border=1\n||! «kind» || B || C ||\n|| «first» || «second» ||", "| «kind» | B | C |\n| --- | --- | --- |\n| «first» | «second» |  |"),
    "table with code": (
        "|| Case || Kind || Code ||\n|| «first» || «kind» ||[@\n«second» «key»\n@]||",
        "* **«first»** — «kind»\n\n  ```text\n  «second» «key»\n  ```",
    ),
    "code side by side": (
        "|| '''«first»''' || '''«second»''' ||\n||[@\na «key»\n@]||[@\nb «key»\n@]||",
        "* **«first»**\n\n  ```text\n  a «key»\n  ```\n\n* **«second»**\n\n  ```text\n  b «key»\n  ```",
    ),
    "note": ("NOTE: use «name»", "> [!NOTE]\n> use «name»"),
    "note with bullets": ("NOTE:\n* «first»\n* «second»", "> [!NOTE]\n> * «first»\n> * «second»"),
    "headings": ("! «kind»\n!! «name»\n!!! «first»", "## «kind»\n### «name»\n#### «first»"),
    "rule": ("«first»\n----\n«second»", "«first»\n\n---\n\n«second»"),
    "bullets": ("* «kind»\n** «first»\n*** «second»", "* «kind»\n  * «first»\n    * «second»"),
    "ordered become bullets": ("# «first»\n## «second»", "* «first»\n  * «second»"),
    "bullet with a bracket": ("* <«first»> x", "* \\`<«first»>` x"),
    "definition": ("   '''''- «first»: '''''The «second».", "  * **«first»:** The «second»."),
    "anchor line": ("[[#«first» «second»]]\n! «name»", "## «name» {#«first»_«second»}"),
    "directive line": ("(:toc:)\n«name»", "«name»"),
    "prose": ("«name» is\n\n\n\n'''«kind»'''.", "«name» is\n\n**«kind»**."),
}


@query("wiki_blocks", wanted(BLOCKS))
def wiki_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs(spark, sf_dir, BLOCKS, pages.wiki_markdown)


PASSES: Cases = {
    "table caption": ("%orange%Table: «name»%%\n\nend", "@@orange|«name»@@\n\nend"),
    "status of a bullet": (
        "* [[http://x.example/html/docs/modules/1.4.x/«first».html|'''«kind»''']] - of «name», beta",
        "* [**«kind»**](/docs/modules/1-4/«first») - of «name» — 🟡 **beta**",
    ),
    "status marks": ("«name» %green%stable%%", "«name» 🟢 **stable**"),
    "status of a row": ("|| A || B ||\n|| '''«first»''' || alpha ||", "| A | B |\n| --- | --- |\n| **«first»** | 🔴 **alpha** |"),
    "label over bullets": ("%red%WARNING%%\n - never «first»\n - it may «second»", "> [!WARNING]\n> Never «first».\n> It may «second»."),
    "label in a line": ("%red%'''WARNING!'''%% mind «name».", "> [!WARNING]\n> mind «name»."),
    "plain label": ("IMPORTANT: take «name».", "> [!IMPORTANT]\n> take «name»."),
    "label in prose": ("NOTE that «name» is «kind».", "NOTE that «name» is «kind»."),
    "red paragraph": ("«first»\n%red%«name» is gone%%\n* «key»\n* «kind»\nend", "«first»\n\n> [!IMPORTANT]\n> «name» is gone\n>\n> * «key»\n> * «kind»\n\nend"),
    "green paragraph": ("%green%«name»%% is new", "> [!NOTE]\n> «name» is new"),
    "red note of a heading": ("! «name» %red%(since «key»)%%\nend", "## «name»\n\n> [!WARNING]\n> since «key»\n\nend"),
    "levels from two, without gaps": ("!!! «kind»\n!!!!! «first»\n!!! «second»", "## «kind»\n### «first»\n## «second»"),
    "anchor of the next heading only": ("[[#«first»]]\n«kind»\n! «name»", "«kind»\n## «name»"),
    "text of links for ids": ("see [[#«first»|«name»]]\n! «name»\n! «kind»", "see [«name»](#«first»)\n## «name» {#«first»}\n## «kind»"),
    "unsafe prose": ("the <«low»> of «name»\n! {«first».len}", "the `<«low»>` of «name»\n## {«first».len}"),
    "link to the old site's manual": (
        "[[http://x.example/Documentation/Page-«key»-4#a|«name»]]", "[«name»](/docs/manual/«key»-4/page#a)"
    ),
    "coloured code": ("$(%blue%<«first»>%%«second»%red%[«key»]%%)", "`$(@@blue|<«first»>@@«second»@@red|[«key»]@@)`"),
    "prose of green code": ("Options are written in green, not in greenish «kind»: @@green|x@@", "Options are written in italics, not in greenish «kind»: @@green|x@@"),
    "green code in parts": ("$(%green%<«first»>%%«second»)", "`$(`*`<«first»>`*`«second»)`"),
    "empty braces once": ("«first»{} of «name»", "«first»\\{\\} of «name»"),
    "green code": ("%green%$«first»%% is code", "`$«first»` is code"),
    "obsolete": ("%red%TO BECOME OBSOLETE «name»%%", "> [!WARNING]\n> TO BECOME OBSOLETE «name»"),
    "rules at the ends, empty comments": ("----\n«name»\n! Comments", "«name»"),
}


@query("wiki_passes", wanted(PASSES))
def wiki_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs(spark, sf_dir, PASSES, pages.wiki_markdown)


SAFE: Cases = {
    "braces": ("the {«first»} of «name»", "the `{«first»}` of «name»"),
    "empty braces": ("«first»{ } x", "«first»\\{\\} x"),
    "a brace alone": ("«first» { «second»", "«first» `{` «second»"),
    "code stays": ("`{«first»}` <em>«name»</em>", "`{«first»}` <em>«name»</em>"),
    "unknown tag": ("<«low»> and </«low»>", "`<«low»>` and `</«low»>`"),
    "element": ('<«low» type="«key»"> x', '`<«low» type="«key»">` x'),
    "address": ("<https://«first».example/«key»>", "[https://«first».example/«key»](https://«first».example/«key»)"),
    "mail": ("<mailto:«first»@«second».example>", "[«first»@«second».example](mailto:«first»@«second».example)"),
    "component": ('<Badge text="{«first»}" />', '<Badge text="{«first»}" />'),
    "arrows": ("«first» <-> «second» <- «kind»", "«first» ↔ «second» ← «kind»"),
    "back link": ("[<-«first»](/«key») «name»", " «name»"),
    "empty tag": ("«first» <> </>", "«first» `<>` `</>`"),
    "colour marker": ("@@red|{«first»}@@ {«second»}", "@@red|{«first»}@@ `{«second»}`"),
    "heading": ("## {«first».len}\n{«second»}", "## {«first».len}\n`{«second»}`"),
    "fence": ("```c\n{«first»}\n```\n{«second»}", "```c\n{«first»}\n```\n`{«second»}`"),
    "indented": ("«kind»\n\n    «first» {\n\n    }\n\nend", "«kind»\n\n```text\n«first» {\n\n}\n```\n\nend"),
    "indented bullet": ("    * {«first»}", "    * `{«first»}`"),
}


@query("safe_markdown", wanted(SAFE))
def safe_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs(spark, sf_dir, SAFE, pages.safe_markdown)


LANGUAGES: Cases = {
    "bash by its first line": ("#!/bin/bash\n«name»", "bash"),
    "sh by its first line": ("\n#!/bin/sh\n«name»", "bash"),
    "python by its first line": ("#!/usr/bin/env python3\n«name»", "python"),
    "perl by its first line": ("#!/usr/bin/perl\n«name»", "perl"),
    "php": ("«name»\n<?php echo «key»; ?>", "php"),
    "sql": ("«name»\n insert into «first» values («key»)", "sql"),
    "a word of sql": ("select", "text"),
    "c by an include": ("#include <«first».h>", "c"),
    "c by a type": ("  struct «first» { int «second»; }", "c"),
    "a module of a script": ('loadmodule "«first».so"', "c"),
    "a route of a script": ("route[«first»]", "c"),
    "a parameter of a script": ("listen = «key»", "c"),
    "perl": ("my $«first» = «key»;", "perl"),
    "a prompt": ("$ «first» «key»", "bash"),
    "a tool": ("«first» | grep «second»", "bash"),
    "a loop": ("for «first» in «second»", "bash"),
    "anything else": ("«name» «key»", "text"),
}


@query("code_languages", wanted(LANGUAGES))
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs(spark, sf_dir, LANGUAGES, pages.code_language)


#: Inputs are ``page|heading|what follows``.
MANUAL_IDS: Cases = {
    "parameter": ("script-coreparameters|«first»_«second»|", "«first»_«second»"),
    "parameter, no name": ("script-coreparameters|«kind» of «name»!|", "«low»_of_«first»_«second»"),
    "parameter, forced": ("script-coreparameters|memlog | mem_log|", "memlog"),
    "function": ("script-corefunctions|«first»_x(a, [«second»])|", "«first»_x"),
    "function of two words": ("script-corefunctions|«name»(x)|", "«first»_«second»"),
    "transformation": ("script-tran|{«first».«second»,«key»}|", "«first».«second»"),
    "transformation, a group": ("script-tran|«kind» group|", "«low»_group"),
    "variable": ("script-corevar|The «name» - $«first»|", "«first»"),
    "variable in brackets": ("script-corevar|$(«first».«second»[«key»])|", "«first».«second»"),
    "variable, none": ("script-corevar|«kind» «name»|", "«low»_«first»_«second»"),
    "command": ("interface-coremi|«first»:«second» [«key»]|", "«first»_«second»"),
    "statistic": ("interface-corestatistics|«first»-«kind»|", "«first»-«kind»"),
    "route": ("script-routes|«first»_route [x]|", "«first»_route_x"),
    "event": ("interface-coreevents|«name»|text\n**Event**: E_«kind»_x\n", "E_«kind»_x"),
    "event, none named": ("interface-coreevents|«name»|«kind»", "«first»_«second»"),
    "event, forced": ("interface-coreevents|Script profiling event|**Event**: E_OTHER", "E_PROFILING_SCRIPT"),
    "forced on a page without rule": ("script-async|Allowed Routes|", "async_routes"),
    "no rule": ("other|«kind» - «name», x|", "«low»---«first»-«second»-x"),
}


@query("manual_ids", wanted(MANUAL_IDS))
def manual_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(given):
        part = lambda i: F.regexp_extract(given, r"(?s)^([^|]*)\|(.*)\|([^|]*)$", i)
        return rules.manual_id(part(1), part(2), part(3))

    return outputs(spark, sf_dir, MANUAL_IDS, of)


#: Inputs are ``level|heading|section|guide``.
ITEM_IDS: Cases = {
    "guide": ("2|«name» Guide||", "«first»_«second»_guide"),
    "section": ("3|About «name»||Admin Guide", "about_«first»_«second»"),
    "parameter": ("4|«first»_«second» (string)|Exported Parameters|Admin Guide", "param_«first»_«second»"),
    "function": ("4|«first»(«second», x)|Exported Functions|Admin Guide", "func_«first»"),
    "asynchronous function": ("4|«first»()|exported asynchronous functions|Admin Guide", "afunc_«first»"),
    "command": ("4|«first»:«second»|Exported MI Functions|Admin Guide", "mi_«second»"),
    "event": ("4|E_«kind»|Exported Events|Admin Guide", "event_e_«low»"),
    "variable": ("4|$(«first»(x)[i])|Exported Pseudo-Variables|Admin Guide", "pv_«first»"),
    "statistic": ("5|«first»_«second»|Exported Statistics|Admin Guide", "stat_«first»_«second»"),
    "identifier": ("4|«kind»|Exported Status/Report Identifiers|Admin Guide", "sr_«kind»"),
    "interface": ("4|«first»_«second»(api)|Available Functions|Developer's Guide", "dev_«first»_«second»"),
    "interface in another guide": ("4|«first»(api)|Available Functions|Admin Guide", "«first»_api"),
    "no typed section": ("4|«name»|Overview|Admin Guide", "«first»_«second»"),
}


@query("module_item_ids", wanted(ITEM_IDS))
def module_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(given):
        part = F.split(given, r"\|")
        return anchors.item_id(part[0].cast("int"), part[1], part[2], part[3])

    return outputs(spark, sf_dir, ITEM_IDS, of)


#: Inputs are ``level|title|guide``.
TITLES: Cases = {
    "guide": ("2|developer's   GUIDE|", "Developer Guide"),
    "section": ("3|MI Commands|Developer Guide", "Exported MI Functions"),
    "bare title, administrators": ("3|Functions|Admin Guide", "Exported Functions"),
    "bare title, developers": ("3|Functions|Developer Guide", "Functions"),
    "a section's title as a guide": ("2|exported events|", "exported events"),
    "own title": ("3|«name»  «kind»|Admin Guide", "«name»  «kind»"),
}


@query("canonical_titles", wanted(TITLES))
def canonical_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(given):
        part = F.split(given, r"\|")
        return rules.canonical_title(part[1], part[0].cast("int"), part[2])

    return outputs(spark, sf_dir, TITLES, of)


#: Each rule is a function of its own.
NAMES: Cases = {
    "linkend label": ("param_«first»_«second»-x", "«first» «second»-x"),
    "heading key": ("The [`«first»`](x) **«kind»**, <b>x</b> {#id}", "the «first» «low» x"),
    "cms slug": ("Café «name» — Ünï!", "cafe-«first»-«second»-uni"),
    "forge slug": ("[«name»](x), **b** *c d* `«kind»_url` «first»-x!", "«first»-«second»-b-c-d-«low»_url-«first»-x"),
    "kept marks": ("  «first».«second» - «kind»!", "«first».«second»_-_«kind»"),
    "spaced slug": ("«name» - «kind»?", "«first»-«second»---«low»"),
    "converted name": ("Documentation.«first»-«kind»-3-6", "«first»-«low»-3-6"),
    "category": ("Docs«key».«name»", "docs«key»"),
    "module version": ("«key».4.x", "«key»-4"),
    "legacy module route": ("http://x.example/html/docs/modules/3.4.x/«first».html#«second»", "/docs/modules/3-4/«first»#«second»"),
    "legacy manual route": ("http://x.example/Documentation/«first»-«second»-3-6#toc2", "/docs/manual/3-6/«first»-«second»#toc2"),
    "module links": ("see http://x.example/html/docs/modules/3.4.x/«first».html now", "see [«first»](../modules/«first») now"),
    "site links": ("[a](«first».md#z) [b](../modules/«second»/README.md)", "[a](/docs/manual/3-4/«first»#z) [b](/docs/modules/3-4/«second»)"),
    "hidden": ("---\ntitle: «name»\n---\n«kind»", "---\ntitle: «name»\nsidebar:\n  hidden: true\n---\n«kind»"),
    "sample line": ('«first»\n[s](./samples.md "include")\n«second»', "«first»\n«second»"),
    "title heading": ("# The **«name»**\n\n«kind»", "«kind»"),
}
NAMES["module title"] = ('"«first»" Module', "«upper» module")


@query("page_names", wanted({k: v for k, v in NAMES.items() if k != "module title"}) + "\nUNION ALL SELECT p_partkey, 'module title', upper(first) || ' module' FROM p")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {
        "module title": rules.module_title,
        "linkend label": names.label_of,
        "heading key": names.heading_key,
        "cms slug": names.cms_slug,
        "forge slug": anchors.forge_slug,
        "kept marks": anchors.kept_marks,
        "spaced slug": anchors.spaced_slug,
        "converted name": names.converted_name,
        "category": names.category,
        "module version": names.module_version_slug,
        "legacy module route": names.legacy_route,
        "legacy manual route": names.legacy_route,
        "module links": names.module_links,
        "site links": lambda c: rules.site_links(c, F.lit("3-4"), "https://x.example"),
        "hidden": rules.hidden,
        "sample line": rules.without_sample_line,
        "title heading": lambda c: names.without_title_heading(c, F.concat(F.lit("the "), F.col("name"))),
    }
    rows = inputs(spark, sf_dir, NAMES)
    output = F.lit(None).cast("string")
    for rule, f in of.items():
        output = F.when(F.col("rule") == rule, f(F.col("input"))).otherwise(output)
    return rows.select("p_partkey", "rule", output.alias("output"))
