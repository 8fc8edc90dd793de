"""Entity hierarchy from HTML pages, as expressions and one Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.session import ship

DETAIL = (
    "cage_business_name string, cage_code string, cage_update_date string, is_highest boolean, immediate_level_owner boolean, "
    "highest_level_owner_name string, highest_level_cage_code string, highest_level_cage_update_date string"
)


def details_link(html: Column) -> Column:
    """Address of the first details link of a search page, null if there is none."""
    hit = F.regexp_extract(html, r"""(?is)<a\b[^>]*href=["']([^"']*/Search/Details\?id=[^"']*)["'][^>]*>[^<]*details""", 1)
    return F.when(hit != "", F.replace(hit, F.lit("&amp;"), F.lit("&")))


def needs_login(url: Column, body: Column) -> Column:
    """Whether a page is a login, consent or challenge page instead of an answer."""
    return (
        body.isNull() | F.lower(F.coalesce(url, F.lit(""))).contains("agree") | F.lower(body).contains("verifying your identity") | body.contains("Access Denied")
    )


def _iso(text: str) -> str:
    for form in ("%m/%d/%Y", "%Y-%m-%d"):
        try:
            return datetime.strptime(text.strip(), form).strftime("%Y-%m-%d")
        except ValueError:
            continue
    return text.strip()


class _Page(HTMLParser):
    """Collects label/value pairs by the block they stand in: ``top`` or the last subsection heading."""

    _VOID = {"br", "img", "input", "meta", "link", "hr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, str]] = []  # tag, id, class
        self.heading, self.label, self.text = "", "", ""
        self.pairs: dict[tuple[str, str], str] = {}
        self.missing: set[str] = set()
        self.headings: set[str] = set()

    def _within(self, name: str) -> bool:
        return any(i == name for _, i, _ in self.open)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in self._VOID:
            self.open.append((tag, a.get("id") or "", a.get("class") or ""))
        if tag in ("label", "span", "td", "div"):
            self.text = ""

    def handle_data(self, data):
        self.text += data
        if self._within("ownership") and re.search(r"information not available", data, re.I):
            self.missing.add(self.heading)

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open and self.open[-1][0] != tag:
            self.open.pop()
        _, _, classes = self.open.pop()
        text = " ".join(self.text.split())
        block = "top" if self._within("detail_topsection") else self.heading if self._within("ownership") else "page"
        if tag == "div" and "subsection_header" in classes.split():
            self.heading = text.lower()
            self.headings.add(self.heading)
        elif tag == "label" or tag == "td" and "detail-left-col" in classes.split():
            self.label = text.lower()
        elif tag == "span" or tag == "td" and "detail-right-col" in classes.split():
            if self.label:
                self.pairs.setdefault((block, self.label), text)
            self.label = ""

    def value(self, block: str, label: str) -> str:
        return next((v for (b, k), v in self.pairs.items() if b == block and label in k), "")

    def exact(self, block: str, label: str) -> str:
        return self.pairs.get((block, label), "")


def read_details(html: str | None) -> dict | None:
    """The fields of ``DETAIL``: the highest owner if known, else the immediate one, else the entity itself."""
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    name = page.value("page", "legal business name")
    code, updated = page.exact("top", "cage"), page.value("top", "cage update date")
    out = {
        "cage_business_name": name, "cage_code": code, "cage_update_date": _iso(updated) if updated else "", "is_highest": True, "immediate_level_owner": False,
        "highest_level_owner_name": name, "highest_level_cage_code": code, "highest_level_cage_update_date": _iso(updated) if updated else "",
    }
    for pattern, immediate in ((r"highest level owner", False), (r"immediate( level)? owner", True)):
        block = next((h for h in page.headings if re.search(pattern, h)), None)
        if block is None:
            if not immediate:
                break
            continue
        if block in page.missing:
            continue
        day = page.value(block, "cage last updated")
        out |= {"is_highest": False, "immediate_level_owner": immediate}
        out["highest_level_owner_name"] = page.value(block, "company name") or out["highest_level_owner_name"]
        out["highest_level_cage_code"] = page.exact(block, "cage") or out["highest_level_cage_code"]
        out["highest_level_cage_update_date"] = _iso(day) if day else out["highest_level_cage_update_date"]
        break
    return out


def parse_details(html: Column) -> Column:
    """Struct of ``DETAIL``; null for null, empty fields for a page without them."""
    ship()

    @F.pandas_udf(DETAIL)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in DETAIL.split(", ")]
        for pages in batches:
            yield pd.DataFrame([read_details(p) or dict.fromkeys(names) for p in pages], columns=names)

    return parse(html)
