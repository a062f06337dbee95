"""OBO files: term stanzas to quads."""

from __future__ import annotations

import re

from lattica.functions.exprs import SYNONYM_SCOPES
from lattica.model import COMMENT, DEPRECATED, LABEL, OBO_IN_OWL, OBO_PURL, OWL, SUB_CLASS, TYPE, XSD
from lattica.sources.rdf import Parsed

DEFINITION = OBO_PURL + "IAO_0000115"


def id_to_iri(obo_id: str, idspaces: dict[str, str]) -> str:
    """http(s) stays; a declared idspace expands; else the PURL."""
    if obo_id.startswith(("http://", "https://")):
        return obo_id
    prefix, colon, local = obo_id.partition(":")
    if colon and prefix in idspaces:
        return idspaces[prefix] + local
    return OBO_PURL + obo_id.replace(":", "_")


def _value(text: str) -> str:
    """A clause without its trailing comment or qualifiers, unescaped."""
    text = re.sub(r"\s+![^\"]*$", "", text)
    text = re.sub(r"\s*\{[^{}]*\}\s*$", "", text)
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "W": " "}.get(m[1], m[1]), text).strip()


def _quoted(text: str) -> tuple[str, str]:
    m = re.match(r'"((?:[^"\\]|\\.)*)"\s*(.*)$', text, re.S)
    return (re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "W": " "}.get(m[1], m[1]), m[1]), m[2]) if m else (text, "")


def parse_obo(text: str, base: str = "") -> Parsed:
    """Terms with name, comment, def, is_obsolete, is_a, synonyms, xrefs and property values; other stanzas are skipped."""
    out = Parsed()
    stanza, own, idspaces, ontology = "", None, out.prefixes, None

    def add(p: str, o: str, kind: str = "literal", datatype: str | None = XSD + "string") -> None:
        out.quads.append((own, "iri", p, o, kind, datatype if kind == "literal" else None, None, None))

    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if not line or line.startswith("!"):
            continue
        if line.startswith("["):
            if not line.endswith("]"):
                out.error, out.line, out.column = out.error or "bad stanza header", out.line or n, 0
            stanza, own = line.strip("[]"), None
            continue
        tag, colon, rest = line.partition(":")
        if not colon:
            out.error, out.line, out.column = out.error or f"expected a clause, found {line[:40]!r}", out.line or n, 0
            continue
        rest = rest.strip()
        if not stanza:
            if tag == "idspace" and len(parts := rest.split()) >= 2:
                idspaces[parts[0]] = parts[1]
            elif tag == "ontology":
                ontology = rest if "://" in rest else f"{OBO_PURL}{rest}.owl"
                out.quads.append((ontology, "iri", TYPE, OWL + "Ontology", "iri", None, None, None))
            elif tag == "import" and ontology:
                out.quads.append((ontology, "iri", OWL + "imports", rest if "://" in rest else f"{OBO_PURL}{rest}", "iri", None, None, None))
            continue
        if stanza != "Term":
            continue
        if tag == "id":
            own = id_to_iri(_value(rest), idspaces)
            add(TYPE, OWL + "Class", "iri")
            add(OBO_IN_OWL + "id", _value(rest))
        elif own is None:
            out.error, out.line, out.column = out.error or "a term starts with its id", out.line or n, 0
        elif tag == "name":
            add(LABEL, _value(rest))
        elif tag == "comment":
            add(COMMENT, _value(rest))
        elif tag == "def":
            add(DEFINITION, _quoted(rest)[0])
        elif tag == "is_obsolete":
            if _value(rest) == "true":
                add(DEPRECATED, "true", "literal", XSD + "boolean")
        elif tag == "is_a":
            add(SUB_CLASS, id_to_iri(_value(rest), idspaces), "iri")
        elif tag == "synonym":
            label, more = _quoted(rest)
            scope = (more.split() or ["RELATED"])[0].upper()
            add(OBO_IN_OWL + SYNONYM_SCOPES.get(scope, "hasRelatedSynonym"), label)
        elif tag == "xref":
            add(OBO_IN_OWL + "hasDbXref", _value(rest).split(" ")[0])
        elif tag == "property_value":
            parts = _value(rest).split(" ", 1)
            if len(parts) == 2:
                p = id_to_iri(parts[0], idspaces) if ":" in parts[0] else OBO_IN_OWL + parts[0]
                if parts[1].startswith('"'):
                    add(p, _quoted(parts[1])[0])
                else:
                    add(p, id_to_iri(parts[1].split(" ")[0], idspaces), "iri")
    return out
