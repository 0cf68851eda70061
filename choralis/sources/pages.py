"""Readers of saved pages of the two sites, and of pages in general, as table functions over html text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.sources import targets

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
COMMENT_ID = "urn:li:comment:"
CARD_KEY = "update-card-focus"
#: Fixed value: a line about someone else's activity above a post.
SOCIAL_CONTEXT = re.compile(
    r"\b((likes?|loves?|celebrates?|supports?|finds|follows?) (this|that)|commented( on)?|replied( to)?|reposted|reacted( to)?)\b", re.I
)
RELATIVE = re.compile(r"^\d+\s*(s|m|h|d|w|mo|yr)", re.I)
TEXT_CLASSES = ("update-components-text", "feed-shared-update-v2__description", "feed-shared-inline-show-more-text")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: int):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """The nodes below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def closest(self, test: Callable[[Node], bool]) -> Node | None:
        n: Node | None = self
        while n is not None and not test(n):
            n = n.parent
        return n

    def has(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "br":
                out.append("\n")
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.children))
        return re.sub(r"[ \t\r\f]+", " ", "".join(out)).strip()

    def leaf(self) -> bool:
        return not any(isinstance(c, Node) for c in self.children)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None, 0)
        self.n = 0

    def handle_starttag(self, tag, attrs):
        self.n += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.n)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _handle(href: str | None) -> str | None:
    for pattern, prefix in ((r"/in/([^/?#]+)", ""), (r"/company/([^/?#]+)", "company-")):
        if m := re.search(pattern, href or ""):
            return prefix + unquote(m[1])
    return None


def _profile(n: Node) -> bool:
    return n.tag == "a" and bool(re.search(r"/in/|/company/", n.attrs.get("href", "")))


# -- X


def _is_tweet(n: Node) -> bool:
    return n.tag == "article" and n.attrs.get("data-testid") == "tweet"


def _is_article(n: Node) -> bool:
    return n.tag == "article"


def read_tweet(el: Node) -> dict | None:
    """A post that has a time link of its own; promoted ones have none, and quoted texts lie in a link card."""
    for t in el.walk():
        if t.tag == "time" and t.closest(_is_article) is el:
            link = t.closest(lambda n: n.tag == "a" and "/status/" in n.attrs.get("href", ""))
            if link and (m := re.match(r"^/([^/]+)/status/(\d+)", link.attrs["href"])):
                break
            if link:
                return None
    else:
        return None
    text = next(
        (n.text() for n in el.walk() if n.attrs.get("data-testid") == "tweetText" and n.closest(_is_article) is el and not n.closest(lambda x: x.tag == "div" and x.attrs.get("role") == "link")),
        "",
    )
    return {"id": m[2], "handle": m[1], "text": text, "time": t.attrs.get("datetime"), "relative": None}


def x_feed(root: Node) -> list[dict]:
    return [dict(x, role="item") for el in root.walk() if _is_tweet(el) and (x := read_tweet(el))]


def x_thread(root: Node, thread_id: str) -> list[dict]:
    """The post with the id, and what isn't older than it; nothing without the post."""
    items = x_feed(root)
    post = next((x for x in reversed(items) if x["id"] == thread_id), None)
    if post is None:
        return []
    later = [dict(x, role="reply") for x in items if x["id"] != thread_id and (x["time"] or "") >= (post["time"] or "")]
    return [dict(post, role="post"), *later]


# -- LinkedIn


def _is_comment(n: Node) -> bool:
    return n.attrs.get("data-id", "").startswith(COMMENT_ID)


def _is_card(n: Node) -> bool:
    return n.attrs.get("data-urn", "").startswith(("urn:li:activity:", "urn:li:ugcPost:"))


def _in_actor(n: Node) -> bool:
    return n.has("update-components-actor__meta-link") or (_profile(n) and n.closest(lambda x: x.has("update-components-actor__container")) is not None)


def _post_text(el: Node) -> str:
    return next((n.text() for n in el.walk() if any(n.has(c) for c in TEXT_CLASSES) and not n.closest(_is_comment)), "")


def linkedin_feed(root: Node) -> list[dict]:
    """Cards of the redesigned layout, then outermost cards of the old one; promoted cards have no author or id."""
    out = redesigned_feed(root)
    for el in root.walk():
        if _is_card(el) and not (el.parent and el.parent.closest(_is_card)):
            m = re.search(r"(\d+)$", el.attrs["data-urn"])
            author = next((n for n in el.walk() if _in_actor(n)), None)
            handle = _handle(author.attrs.get("href")) if author else None
            if m and handle:
                out.append({"id": m[1], "handle": handle, "text": _post_text(el), "time": None, "relative": None, "role": "item"})
    return out


def redesigned_header(card: Node) -> tuple[Node | None, bool, str | None]:
    """Author link, whether promoted, and the relative time, of what stands above a card's text."""
    body = next((n for n in card.walk() if n.attrs.get("data-testid") == "expandable-text-box"), None)
    above = [n for n in card.walk() if body is None or (n.order < body.order and body.closest(lambda x, n=n: x is n) is None)]
    leaves = [n for n in above if n.tag in ("span", "p", "div", "a") and n.leaf() and n.text()]
    context = next((n for n in leaves if SOCIAL_CONTEXT.search(n.text()) and len(n.text()) < 120), None)
    author = next(
        (n for n in above if _profile(n) and n.text() and not (context and (context.closest(lambda x, n=n: x is n) is not None or n.order < context.order))), None
    )
    promoted = any(re.fullmatch(r"promoted|sponsored", n.text(), re.I) for n in leaves)
    return author, promoted, next((n.text() for n in leaves if RELATIVE.match(n.text())), None)


def redesigned_feed(root: Node) -> list[dict]:
    out = []
    for el in root.walk():
        if el.attrs.get("role") == "listitem" and el.attrs.get("componentkey", "").startswith(CARD_KEY):
            key = re.sub(r"[^\w-]", "", el.attrs["componentkey"][len(CARD_KEY) :], flags=re.A)
            author, promoted, relative = redesigned_header(el)
            handle = _handle(author.attrs.get("href")) if author else None
            if key and not promoted and handle:
                text = next((n.text() for n in el.walk() if n.attrs.get("data-testid") == "expandable-text-box"), "")
                out.append({"id": f"li-{key}"[:100], "handle": handle, "text": text, "time": None, "relative": relative, "role": "item"})
    return out


def linkedin_thread(root: Node, thread_id: str) -> list[dict]:
    """The post and its comments; what belongs to a nested comment isn't taken for its parent's."""
    every = list(root.walk())
    post = next((n for n in every if n.attrs.get("data-urn", "").endswith(f":{thread_id}")), None) or next((n for n in every if _is_card(n)), None)
    post = post or next((n for n in every if n.has("feed-shared-update-v2")), None)
    if post is None:
        return []
    author = next((n for n in post.walk() if _in_actor(n) or _profile(n)), None)
    out = [{"id": thread_id, "handle": (_handle(author.attrs.get("href")) if author else None) or "author", "text": _post_text(post), "time": None, "relative": None, "role": "post"}]
    for el in every:
        if not _is_comment(el):
            continue
        own = [n for n in el.walk() if n.closest(_is_comment) is el]
        m = re.search(r"(\d+)\)?$", el.attrs["data-id"])
        author = next((n for n in own if _profile(n)), None)
        handle = _handle(author.attrs.get("href")) if author else None
        if not m or not handle:
            continue
        text = next((n.text() for n in own if n.has("update-components-text") or "comment-item__main-content" in n.attrs.get("class", "")), "")
        relative = next((n.text() for n in own if n.tag == "time" or n.has("comments-comment-meta__data")), None)
        out.append({"id": m[1], "handle": handle, "text": text, "time": None, "relative": relative, "role": "reply"})
    return out


READERS: dict[str, Callable[[Node, str | None], list[dict]]] = {
    "x_feed": lambda root, _: x_feed(root),
    "x_thread": lambda root, thread: x_thread(root, thread or ""),
    "linkedin_feed": lambda root, _: linkedin_feed(root),
    "linkedin_thread": lambda root, thread: linkedin_thread(root, thread or ""),
}
ITEM = "page string, role string, item int, id string, handle string, text string, time string, relative string, now long"


def read_pages(pages: DataFrame) -> DataFrame:
    """Items of saved pages (page, reader, thread_id, html, now): role, item, id, handle, text, created_at.

    Times come from the page, from ids or from relative labels; a reply is never earlier than its post.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "handle", "text", "time", "relative"]
        for rows in frames:
            out = []
            for page, reader, thread, html, now in zip(rows["page"], rows["reader"], rows["thread_id"], rows["html"], rows["now"], strict=True):
                for k, x in enumerate(READERS[reader](tree(html), thread)):
                    out.append([page, x["role"], k, *(x[n] for n in names), now])
            yield pd.DataFrame(out, columns=["page", "role", "item", *names, "now"])

    told = pages.select(F.col("page").cast("string"), "reader", "thread_id", "html", F.unix_micros("now").alias("now"))
    items = told.mapInPandas(run, ITEM).withColumn("now", F.timestamp_micros("now"))
    at = F.coalesce(F.col("time").try_cast("timestamp"), targets.created_at(F.col("id"), F.col("relative"), F.col("now")))
    items = items.withColumn("created_at", at)
    posted = items.where("role = 'post'").select("page", F.col("created_at").alias("posted_at"))
    items = items.join(posted, "page", "left")
    return items.select("page", "role", "item", "id", "handle", "text", F.greatest("created_at", F.when(F.col("role") == "reply", F.col("posted_at"))).alias("created_at"))


def page_outline(pages: DataFrame) -> DataFrame:
    """page_id, title, links and words of general pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for page, html in zip(rows["page_id"], rows["html"], strict=True):
                root = tree(html)
                title = next((n.text() for n in root.walk() if n.tag == "title"), None)
                links = sum(n.tag == "a" and "href" in n.attrs for n in root.walk())
                out.append((page, title, links, len(root.text().split())))
            yield pd.DataFrame(out, columns=["page_id", "title", "links", "words"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, links long, words long")
