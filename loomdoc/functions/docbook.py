"""XML manuals to Markdown rows: entities, one generator per element, heading ids.

``rows`` walks a document and yields (kind, level, text, id) in order; nothing is kept but what ids need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree


# Tags by how they are rendered, title spellings, id prefixes by section, callouts.
CODE_TAGS = set("varname function literal command code option constant type classname envar parameter computeroutput filename userinput".split())
LISTING_TAGS = {"programlisting", "screen", "literallayout"}
PARA_TAGS = {"para", "simpara"}
CALLOUT_TAGS = {"note", "tip", "important", "warning", "caution"}
BLOCK_TAGS = LISTING_TAGS | CALLOUT_TAGS | {"itemizedlist", "orderedlist", "simplelist", "variablelist", "table", "informaltable", "example"}
SECTION_TAGS = {"chapter", "section", "refsect1", "refsect2", "refsect3"}
DROPPED_SECTIONS = {"contributors", "documentation"}
GUIDES = {
    "admin guide": "Admin Guide",
    "developer guide": "Developer Guide",
    "developer's guide": "Developer Guide",
    "frequently asked questions": "Frequently Asked Questions",
}
#: Bare titles that mean an exported section, under the administrators' guide only.
ADMIN_SECTIONS = {"functions": "Exported Functions", "parameters": "Exported Parameters"}
SECTIONS = {
    "exported parameters": "Exported Parameters",
    "exported functions": "Exported Functions",
    "exported asynchronous functions": "Exported Asynchronous Functions",
    "exported asyncronous functions": "Exported Asynchronous Functions",
    "exported async functions": "Exported Asynchronous Functions",
    "exported mi functions": "Exported MI Functions",
    "mi commands": "Exported MI Functions",
    "exported events": "Exported Events",
    "exported pseudo-variables": "Exported Pseudo-Variables",
    "exported pseudo variables": "Exported Pseudo-Variables",
    "exported statistics": "Exported Statistics",
    "exported status/report identifiers": "Exported Status/Report Identifiers",
    "known issues": "Known Issues",
    "known limitations": "Known Limitations",
}
PREFIXES = {
    "exported parameters": "param",
    "exported functions": "func",
    "exported asynchronous functions": "afunc",
    "exported mi functions": "mi",
    "exported events": "event",
    "exported pseudo-variables": "pv",
    "exported statistics": "stat",
    "exported status/report identifiers": "sr",
}
LABELLED_KINDS = {"func", "param", "event", "pv"}
DEVELOPER_SECTIONS = {"available functions", "api functions", "functions"}
XML_ENTITIES = {"amp", "lt", "gt", "quot", "apos"}
ROUNDS = 10

Row = tuple[str, int, str, str | None]


def declared_entities(text: str) -> dict[str, str]:
    """``<!ENTITY name "value">`` declarations; a single-quoted one wins over a double-quoted one."""
    out = dict(re.findall(r'<!ENTITY\s+([\w.-]+)\s+"([^"]*)"\s*>', text))
    return out | dict(re.findall(r"<!ENTITY\s+([\w.-]+)\s+'([^']*)'\s*>", text))


def system_entities(text: str) -> dict[str, str]:
    """``<!ENTITY name SYSTEM "path">`` declarations."""
    return dict(re.findall(r"<!ENTITY\s+([\w.-]+)\s+SYSTEM\s+[\"']([^\"']+)[\"']\s*>", text))


def substituted(text: str, entities: dict[str, str]) -> str:
    """References replaced until nothing changes, ten rounds at most; unknown ones are escaped, XML's own stay."""
    for _ in range(ROUNDS):
        done = re.sub(r"&([\w.-]+);", lambda m: m[0] if m[1] in XML_ENTITIES else entities.get(m[1], m[0]), text)
        if done == text:
            break
        text = done
    return re.sub(r"&(?!#)([\w.-]+);", lambda m: m[0] if m[1] in XML_ENTITIES else f"&amp;{m[1]};", text)


def without_doctype(text: str) -> str:
    """Text without its DOCTYPE, whose brackets may nest."""
    start = text.find("<!DOCTYPE")
    if start < 0:
        return text
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "[") - (text[i] == "]")
        if text[i] == ">" and depth == 0:
            return text[:start] + text[i + 1 :]
    return text[:start]


def tag_of(node: ElementTree.Element) -> str:
    return node.tag.lower() if isinstance(node.tag, str) else ""


def label_of(linkend: str) -> str:
    """What a link says that has no text: the name behind a kind of item, else all words of the id."""
    kind, _, name = linkend.partition("_")
    return name.replace("_", " ") if kind in LABELLED_KINDS and name else re.sub("[_-]", " ", linkend)


def inline(node: ElementTree.Element) -> str:
    return (node.text or "") + "".join(span(child) + (child.tail or "") for child in node)


def span(node: ElementTree.Element) -> str:
    """An inline element without its tail."""
    tag, text = tag_of(node), inline(node)
    if tag == "emphasis":
        mark = "**" if "bold" in (node.get("role") or "").lower() else "*"
        return f"{mark}{text.strip()}{mark}"
    if tag in CODE_TAGS:
        return f"`{text}`"
    if tag == "quote":
        return f'"{text}"'
    if tag in ("ulink", "link", "xref"):
        end = node.get("linkend", "")
        url = node.get("url") or (f"#{end}" if end else "")
        if tag == "ulink" and url and not re.search("/|^#", url):
            url = f"../{url}"
        return f"[{text.strip() or label_of(end) or url}]({url})"
    if tag in ("superscript", "subscript"):
        return f"<{tag[:3]}>{text}</{tag[:3]}>"
    if tag in PARA_TAGS:
        return text.strip()
    if tag in LISTING_TAGS:
        return f"\n```c\n{(node.text or '').rstrip()}\n```\n"
    return text


def paragraphs(node: ElementTree.Element) -> list[str]:
    return [t for child in node if tag_of(child) in PARA_TAGS and (t := inline(child).strip())]


def title_of(node: ElementTree.Element) -> str:
    """The title on one line, without code marks."""
    return next((" ".join(inline(c).replace("`", "").split()) for c in node if tag_of(c) == "title"), "")


def canonical_title(title: str, level: int, guide: str | None) -> str:
    """The usual spelling of guide titles (level 2) and section titles (deeper)."""
    key = " ".join(title.lower().split())
    if level == 2:
        return GUIDES.get(key, title)
    return (guide == "Admin Guide" and ADMIN_SECTIONS.get(key)) or SECTIONS.get(key, title)


def heading_text(markdown: str) -> str:
    return re.sub("[`*]", "", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", markdown)).strip()


def underscored(text: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "_", text).strip("_")


def item_name(text: str, prefix: str) -> str:
    """The part of an item's heading that names it: before brackets; after the last colon for MI; without ``$`` for variables."""
    text = text.strip()
    if prefix == "mi":
        text = text.rpartition(":")[2]
    if prefix == "pv":
        text = re.split(r"[(\[]", re.sub(r"^\$\(?", "", text))[0]
    elif prefix in ("func", "afunc", "param", "mi"):
        text = text.partition("(")[0]
    name = underscored(text)
    return name.lower() if prefix == "event" else name


def heading_id(level: int, text: str, section: str | None, guide: str | None) -> str | None:
    """The id of a heading before duplicates are told apart."""
    if level >= 4 and section:
        prefix = PREFIXES.get(section.lower())
        developer = re.fullmatch(r"developer(?:'s)? guide", (guide or "").strip(), re.I)
        if not prefix and developer and section.lower() in DEVELOPER_SECTIONS:
            name = item_name(text, "func")
            return f"dev_{name}" if name else None
        if prefix:
            name = item_name(text, prefix)
            return f"{prefix}_{name}" if name else None
    return underscored(text).lower() or None


class Walk:
    """Rows of one document; ``ids`` maps legacy ids and ordinals (``tocN``) to ids."""

    def __init__(self, root: ElementTree.Element):
        self.root, self.used, self.ids = root, set(), {}
        self.guide = self.section = None
        self.n_headings, self.sampled = 0, False

    def rows(self) -> Iterator[Row]:
        return self.block(self.root, 1)

    def heading(self, level: int, title: str, legacy: str | None, context: bool = True) -> Row:
        text = heading_text(title)
        if context and level == 2:
            self.guide, self.section = text, None
        elif context and level == 3:
            self.section = text
        base = heading_id(level, text, None if level < 4 else self.section, self.guide)
        id_, n = base, 2
        while id_ in self.used:
            id_, n = f"{base}_{n}", n + 1
        if id_:
            self.used.add(id_)
            self.n_headings += 1
            self.ids[f"toc{self.n_headings}"] = id_
            if legacy:
                self.ids[legacy] = id_
        return ("heading", level, f"{'#' * level} {title}", id_)

    def block(self, node: ElementTree.Element, depth: int) -> Iterator[Row]:
        tag = tag_of(node)
        if tag in SECTION_TAGS:
            yield from self.in_section(node, depth)
        elif tag in PARA_TAGS:
            yield from self.paragraph(node, depth)
        elif tag in LISTING_TAGS:
            yield self.code(node, "")
        elif tag in ("itemizedlist", "orderedlist"):
            items = self.items(node, tag == "orderedlist", 0)
            if items:
                yield ("list", 0, items, None)
        elif tag == "simplelist":
            members = [inline(c).strip() for c in node if tag_of(c) == "member"]
            if members:
                inlined = node.get("type", "vert") == "inline"
                yield ("list", 0, ", ".join(members) if inlined else "\n".join(f"- {m}" for m in members), None)
        elif tag == "variablelist":
            for entry in node:
                yield from self.term(entry, depth)
        elif tag in CALLOUT_TAGS:
            if body := " ".join(paragraphs(node)):
                yield ("alert", 0, f"> [!{tag.upper()}]\n> {body}", None)
        elif tag == "example":
            title = title_of(node)
            for child in node:
                if tag_of(child) in LISTING_TAGS:
                    yield self.code(child, title)
                elif tag_of(child) != "title":
                    yield from self.block(child, depth)
        elif tag == "qandaset":
            for entry in node:
                yield from self.answer(entry)
        elif tag in ("table", "informaltable"):
            yield from self.table(node)
        elif tag == "bridgehead":
            if title := inline(node).strip():
                yield self.heading(min(depth + 1, 6), title, None, context=False)
        elif tag not in ("bookinfo", "title", "titleabbrev"):
            for child in node:
                yield from self.block(child, depth)

    def in_section(self, node: ElementTree.Element, depth: int) -> Iterator[Row]:
        if (node.get("id") or "").lower() in DROPPED_SECTIONS:
            return
        level, title = min(depth + 1, 6), title_of(node)
        if title:
            yield self.heading(level, canonical_title(title, level, self.guide), node.get("id"))
        for child in node:
            if tag_of(child) != "title":
                yield from self.block(child, depth + 1)

    def paragraph(self, node: ElementTree.Element, depth: int) -> Iterator[Row]:
        """Text between block children is a paragraph each."""
        waiting = node.text or ""
        for child in [*node, None]:
            blocky = child is not None and tag_of(child) in BLOCK_TAGS
            if child is None or blocky:
                text = waiting.strip()
                legal = child is None and not any(tag_of(c) in BLOCK_TAGS for c in node) and re.match("©|Copyright|.*Documentation Copyrights", text)
                if text and not legal:
                    yield ("para", 0, text, None)
                waiting = ""
            if blocky:
                yield from self.block(child, depth)
                waiting = child.tail or ""
            elif child is not None:
                waiting += span(child) + (child.tail or "")

    def code(self, node: ElementTree.Element, title: str) -> Row:
        sample = node.find(".//cfgsample")
        if sample is not None:
            first, self.sampled = not self.sampled, True
            return ("sample", int(first), f'[{title or "samples"}](./samples.md "include")', sample.get("src"))
        shown = ' title="' + title.replace('"', "'") + '"' if title else ""
        return ("code", 0, f"```c{shown}\n{(node.text or '').strip(chr(10))}\n```", None)

    def items(self, node: ElementTree.Element, ordered: bool, indent: int) -> str:
        entries = [c for c in node if tag_of(c) == "listitem"]
        return "\n".join(" " * indent + (f"{k}. " if ordered else "- ") + self.item(c, indent) for k, c in enumerate(entries, 1))

    def item(self, node: ElementTree.Element, indent: int) -> str:
        parts, pad = [(node.text or "").strip()], "  "
        for child in node:
            tag = tag_of(child)
            if tag in ("itemizedlist", "orderedlist"):
                parts.append("\n" + self.items(child, False, indent + 2))
            elif tag in LISTING_TAGS:
                lines = [pad + x for x in (child.text or "").strip("\n").splitlines()]
                parts.append("\n".join(["", f"{pad}```", *lines, f"{pad}```"]))
            elif tag in CALLOUT_TAGS:
                parts.append(f"\n{pad}> **{tag.capitalize()}:** {' '.join(paragraphs(child))}")
            else:
                parts.append(inline(child).strip())
        return "\n".join(p for p in parts if p)

    def term(self, entry: ElementTree.Element, depth: int) -> Iterator[Row]:
        if tag_of(entry) != "varlistentry":
            return
        terms = [inline(c).strip() for c in entry if tag_of(c) == "term"]
        if terms:
            yield ("term", 0, f"**{', '.join(terms)}**", None)
        for child in (c for e in entry if tag_of(e) == "listitem" for c in e):
            yield from self.block(child, depth + 1)

    def answer(self, entry: ElementTree.Element) -> Iterator[Row]:
        parts = {tag_of(c): paragraphs(c) for c in entry}
        if question := " ".join(parts.get("question", [])):
            yield ("qa", 0, f"**Q: {question}**", None)
        if reply := "\n\n".join(parts.get("answer", [])):
            yield ("qa", 0, reply, None)

    def table(self, node: ElementTree.Element) -> Iterator[Row]:
        cells = lambda part: [
            [inline(e).strip().replace("|", "\\|") for e in row if tag_of(e) == "entry"] for row in node.iterfind(f"tgroup/{part}/row")
        ]
        head, body = cells("thead"), cells("tbody")
        width = max((len(r) for r in [*head, *body]), default=0)
        if not width:
            return
        if title := title_of(node):
            yield ("para", 0, f"**{title}**", None)
        padded = [r + [""] * (width - len(r)) for r in [head[-1] if head else [], *body]]
        lines = ["| " + " | ".join(r) + " |" for r in padded]
        yield ("table", width, "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]), None)


#: Files of a manual that are parts of others.
FRAGMENT = re.compile("_admin|_faq|_devel|contributors")


def combined(module: str, files: dict[str, str], entities: dict[str, str]) -> tuple[str, dict[str, str]] | None:
    """The main text of a module's folder (file name: text), and all entities it can use: those of the branch, its own, and
    its files by the names they are declared with. Scripts become a mark for a sample, files that lack become nothing. None
    if the folder has no main text."""
    main = f"{module}.xml"
    if main not in files:
        main = min((f for f in files if f.endswith(".xml") and not FRAGMENT.search(f)), default=None)
    if main is None:
        return None
    text = files[main]
    known = entities | declared_entities(text)
    for name, path in system_entities(text).items():
        file = path.rpartition("/")[2]
        if path.lower().endswith(".cfg"):
            known[name] = f'<cfgsample src="{file}"/>' if file in files else ""
        else:
            known[name] = re.sub(r"(?s)\A\s*<!--.*?-->\s*", "", files.get(file, ""))
    return text, known


def parsed(xml: str, entities: dict[str, str]) -> ElementTree.Element | None:
    """The document's root; None if it is not well-formed. Its own entities go before ``entities``."""
    text = without_doctype(re.sub(r"<\?xml[^?]*\?>", "", xml))
    text = re.sub(r"(?s)<!--.*?-->", "", substituted(text, entities | declared_entities(xml)))
    try:
        return ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        return None


def document(name: str, xml: str, entities: dict[str, str]) -> dict | None:
    """title, description, body (Markdown), ids and samples of a module's XML; None if it cannot be parsed."""
    root = parsed(xml, entities)
    if root is None:
        return None
    walk = Walk(root)
    rows = [r for r in walk.rows()]
    body = "\n\n".join(text for kind, level, text, _ in rows if kind != "sample" or level)
    body = re.sub(r"\]\(#([^)\s]+)\)", lambda m: f"](#{walk.ids.get(m[1], m[1])})", body)
    info = next((e for e in root.iter() if tag_of(e) == "bookinfo"), None)
    overview = next((s for s in root.iter() if tag_of(s) == "section" and "overview" in title_of(s).lower()), None)
    about = " ".join(next(iter(paragraphs(overview)), "").split()) if overview is not None else ""
    return {
        "title": (title_of(info) if info is not None else "") or name,
        "description": about if len(about) <= 300 else about[:297] + "...",
        "body": body,
        "ids": walk.ids,
        "samples": [id_ for kind, _, _, id_ in rows if kind == "sample"],
    }
