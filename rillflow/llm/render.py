"""Wiki markup as its reader sees it, as words.

Shown: link labels (or the target where there is none), values of template parameters, what tags enclose. Not shown: comments,
footnotes, link targets, template and parameter names, tags, table markup, invisible characters.
"""

from __future__ import annotations

import html
import re
import unicodedata

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_HIDDEN = re.compile(r"<(ref|script|style|math|templatedata)\b[^<>]*?/>|<(ref|script|style|templatedata)\b[^<>]*?(?<!/)>.*?</\2\s*>|<(\w+)[^<>]*display\s*:\s*none[^<>]*>.*?</\3\s*>", re.S | re.I)
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_OUTSIDE = re.compile(r"\[(?:https?:|ftp:|mailto:|//)[^\s\[\]]*\s?([^\[\]]*)\]")
_URL = re.compile(r"\b(?:https?|ftp)://[^\s<>\[\]|{}]+")
_TEMPLATE = re.compile(r"\{\{\{([^{}]*)\}\}\}|\{\{([^{}]*)\}\}")
_PARAMETER = re.compile(r"^\s*[^=|<>\[\]{}\n]{1,60}=")
_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|hr|h[1-6]|blockquote|center|poem|pre|gallery|dd|dt|dl|section)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_QUOTES = re.compile(r"''+")
_TABLE = re.compile(r"^\s*(?:\{\||\|-|\|\}).*$", re.M)
_CELL = re.compile(r"\b(?:(?:colspan|rowspan|style|class|align|valign|width|scope|bgcolor)\s*=\s*(?:\"[^\"\n]*\"|[^\s|\"]+)\s*)+\|(?!\|)", re.I)
_SWITCH = re.compile(r"__[A-ZÀ-Þ]+__")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_WORDS = re.compile(r"[^\W_]+")
# Name spaces whose links show no text, and those whose links show their caption.
_SILENT = ("category", "kategorie", "catégorie", "categoría", "template", "vorlage", "modèle", "plantilla")
_MEDIA = ("file", "image", "datei", "bild", "fichier", "archivo", "imagen", "media")


def _link(m: re.Match) -> str:
    target, bar, label = m.group(1).partition("|")
    colon = target.partition(":")
    if colon[1] and (space := colon[0].strip().lower()):
        if space in _SILENT:
            return " "
        if space in _MEDIA:
            return f" {label.rpartition('|')[2]} "
    if not bar:
        return target.removeprefix(":").replace("#", " ")
    return label if label else re.sub(r"\s*\([^()]*\)$", "", target)


def _values(m: re.Match) -> str:
    parts = (m.group(1) if m.group(2) is None else m.group(2)).split("|")
    return " " + " ".join(_PARAMETER.sub(" ", p) for p in parts[1:]) + " "


def shown(text: str) -> str:
    """The text as shown; markup that isn't closed is shown as it is."""
    t = text
    if "<" in t:
        if "<!--" in t:
            t = _COMMENT.sub("", t)
        t = _HIDDEN.sub("", t)
    if "[" in t:
        if "[[" in t:
            for _ in range(4):
                t, n = _LINK.subn(_link, t)
                if not n:
                    break
        t = _OUTSIDE.sub(r" \1 ", t)
    if "://" in t:
        t = _URL.sub(" ", t)
    if "{{" in t:
        for _ in range(20):
            t, n = _TEMPLATE.subn(_values, t)
            if not n:
                break
    if "{|" in t or "|-" in t:
        t = _TABLE.sub(" ", _CELL.sub(" ", t))
    if "<" in t:
        t = _BLOCK.sub(" ", t)
        t = _TAG.sub("", t)
    if "''" in t:
        t = _QUOTES.sub("", t)
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t)
    if "__" in t:
        t = _SWITCH.sub(" ", t)
    return t


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the text as shown, without case."""
    return _WORDS.findall(shown(text).casefold()) if text else []


def plain_words(text: str | None) -> list[str]:
    """Words of a text that has no markup."""
    return _WORDS.findall(unicodedata.normalize("NFKC", _INVISIBLE.sub("", html.unescape(text))).casefold()) if text else []
