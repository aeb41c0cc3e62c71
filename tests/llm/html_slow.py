"""The rules of samewise.llm.html over a tree of elements, by definition and without care for time."""

import re
from html.parser import HTMLParser

from samewise.llm import html as H

#: The names on generated pages that name a part outside the article, told by hand, with whether that is reader comments.
PARTS = {"ad": False, "cookie-notice": False, "comments": True, "sidebarLeft": False, "navigation": False, "user-comments": True, "left-rail": False, "ad-top-box": False, "blog-wide-comments": True}
BLOCKS = set("address article aside blockquote body div footer form h1 h2 header html li main nav p section table td tr ul".split())
SKIP = {"script", "style", "head"}


class Node:
    def __init__(self, tag, attributes=(), up=None):
        self.tag, self.up, self.children = tag, up, []
        names = [x for k, v in attributes if k in ("class", "id", "role") for x in (v or "").split()]
        named = next((x for x in names if x in PARTS), None)
        self.comments = PARTS.get(named, False)
        self.hinted = tag == "form" or named is not None and tag not in ("html", "body", "main") and (tag != "article" or self.comments)

    def path(self):
        return [self, *self.up.path()] if self.up else [self]


class Tree(HTMLParser):
    def __init__(self, text):
        super().__init__()
        self.root = self.now = Node("")
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attributes):
        node = Node(tag, attributes, self.now)
        self.now.children.append(node)
        if tag not in ("br", "meta", "img"):
            self.now = node

    def handle_endtag(self, tag):
        for x in self.now.path():
            if x.tag == tag:
                self.now = x.up
                break

    def handle_data(self, data):
        self.now.children.append(data)


def runs_of(root):
    """Lists of (text, nodes from the text outwards), cut at block elements."""
    runs = [[]]

    def walk(node):
        if node.tag in BLOCKS:
            runs.append([])
        for child in node.children:
            if isinstance(child, str):
                runs[-1].append((child, node.path()))
            elif child.tag == "br" or child.tag in SKIP:
                runs[-1].append((" ", node.path()))
            else:
                walk(child)
        if node.tag in BLOCKS:
            runs.append([])

    walk(root)
    return [r for r in runs if any(t for t, _ in r)]


def squeeze(pieces):
    return " ".join("".join(t for t, _ in pieces).split())


def link_chars(pieces):
    return sum(len("".join(t.split())) for t, path in pieces if any(x.tag == "a" for x in path))


def main_of(path):
    return next((x for x in path if x.tag in ("article", "main")), None)


def struck(path):
    """In a part that its tag names."""
    return any(x.tag in ("nav", "footer", "aside", "menu") or x.tag == "header" and not main_of(x.path()) for x in path)


def share_of_stops(texts):
    words = [w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())]
    return sum(w in H.STOP_WORDS for w in words), len(words)


def known(texts):
    a, b = share_of_stops(texts)
    return a >= H.KNOWN_SHARE * b


def decide(text, link, bad, main, language=True):
    if bad:
        return False
    if link > H.LINK_SHARE * len(text.replace(" ", "")):
        return "open"
    if len(text) < H.LONG_CHARS:
        return None
    a, b = share_of_stops([text])
    if not language or b and a >= H.STOP_SHARE * b:
        return True
    return None if main else "open"


def slow_text(html):
    runs = runs_of(Tree(html or "").root)
    segments = []
    for run in runs:
        last = object()
        for t, path in run:
            if struck(path):
                continue
            mark = next((x for x in path if x.hinted), None)
            if mark is not last:
                segments.append([])
                last = mark
            segments[-1].append((t, path))
    facts = [(squeeze(s), link_chars(s), s[0][1], main_of(s[0][1]) is not None) for s in segments]
    language = any(decide(t, n, False, False) is True for t, n, _, _ in facts) or known(t for t, _, _, _ in facts)
    held = [(len(t), path, main) for t, n, path, main in facts if decide(t, n, False, False, language) is True]
    total, total_main = sum(n for n, _, _ in held), sum(n for n, _, m in held if m)

    def wrapper(node):
        own, own_main = (sum(n for n, path, m in held if node in path and (m or not only)) for only in (False, True))
        share = 0.5 if total_main and not node.comments else 1 - H.WRAPPED
        return own > 0 and own >= share * total and own_main == total_main or has_main(node)

    def has_main(node):
        return any(x is not node and x.tag == "main" for x in nodes(node))

    bad_nodes = {}

    def bad(path):
        for x in path:
            if x.hinted and id(x) not in bad_nodes:
                bad_nodes[id(x)] = not wrapper(x)
        return struck(path) or any(x.hinted and bad_nodes[id(x)] for x in path)

    cut = []
    for run in runs:
        for want in (False, True):
            pieces = [x for x in run if bad(x[1]) == want]
            if squeeze(pieces):
                cut.append((squeeze(pieces), link_chars(pieces), want, main_of(run[0][1])))
                break
    first = [decide(*b) for b in cut]
    if True not in first and not known(b[0] for b in cut if not b[2]):
        first = [decide(*b, language=False) for b in cut]
    alone = True not in first
    sure = {i: x for i, x in enumerate(first) if x in (True, False)}
    for i, x in enumerate(first):
        if x == "open":
            ends = [sure[max((j for j in sure if j < i), default=None)] if any(j < i for j in sure) else False, sure[min(j for j in sure if j > i)] if any(j > i for j in sure) else False]
            first[i] = all(ends)
    out = []
    for i, (text, _, _, main) in enumerate(cut):
        label = first[i]
        if label is None:
            same = [(abs(i - j), not first[j]) for j in range(len(cut)) if first[j] is not None and not cut[j][2] and cut[j][3] is main]
            every = [(abs(i - j), not first[j]) for j in range(len(cut)) if first[j] is not None]
            near = same or ([] if main else every)
            label = alone or (not min(near)[1] if near else main is not None)
        if label:
            out.append(text)
    return "\n\n".join(out)


def nodes(node):
    yield node
    for child in node.children:
        if isinstance(child, Node):
            yield from nodes(child)
