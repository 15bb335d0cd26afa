"""Removal of inline markup from short field values, keeping their text (driver- and worker-side Python)."""

from __future__ import annotations

import html
import re

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF = re.compile(r"<ref\b[^>]*/\s*>|<ref\b[^>]*>.*?</ref\s*>", re.S | re.I)
_BREAK = re.compile(r"<br\s*/?\s*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_MD_LINK = re.compile(r"!?\[([^\[\]]*)\]\((?:[^()\s]|\([^()]*\))*\)")
_EXT_LINK = re.compile(r"\[https?://\S+\s+([^\[\]]*)\]")
_QUOTES = re.compile(r"'{2,5}")
_STARS = re.compile(r"\*\*|__|(?<![\w*])\*(?=\S)|(?<=\S)\*(?![\w*])|`+")
_TEX = re.compile(r"\\(?:text)?(?:bf|it|tt|rm|sc|emph|textbf|textit|textrm|texttt|underline)\s*\{([^{}]*)\}|\\emph\{([^{}]*)\}")
_ANY = re.compile(r"\{\{\s*[\w .-]+\|\s*([^{}|=]*)\}\}")
_WRAP = re.compile(r"\{\{\s*(?:nowrap|nobr|circa|c\.|small|big|abbr|lang|val|ill|ubl|plainlist|flatlist|plain list|unbulleted list)\s*\|([^{}]*)\}\}", re.I)


def strip_inline(text: str) -> str:
    """The value without references, comments, tags, links, emphasis and entities. Line breaks become newlines."""
    t = html.unescape(text) if "&" in text else text
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _COMMENT.sub("", t)
        t = _REF.sub("", t)
        t = _BREAK.sub("\n", t)
        t = _TAG.sub("", t)
    if "{{" in t:
        for _ in range(3):
            t = _WRAP.sub(r"\1", t)
            t = _ANY.sub(r"\1", t)
    if "[" in t:
        t = _LINK.sub(r"\1", t)
        t = _MD_LINK.sub(r"\1", t)
        t = _EXT_LINK.sub(r"\1", t)
    if "''" in t:
        t = _QUOTES.sub("", t)
    if "\\" in t:
        t = _TEX.sub(lambda m: m.group(1) or m.group(2) or "", t)
    if "*" in t or "`" in t or "__" in t:
        t = _STARS.sub("", t)
    return t.replace("\u00a0", " ").strip()
