"""Seeded documents with planted personal data of the added kinds, and with strings that look like it but are none."""

import random

WORDS = "river stone market evening winter garden letter music paper window bridge morning silver forest travel summer kitchen corner station harvest".split()
FIRST = "James Mary Robert Linda Susan Thomas Anna Hans Marie Carlos".split()
LAST = "Walker Brenner Holloway Marchetti Lindqvist Castellano Okafor Pemberton".split()


def personal(n=600, seed=5):
    """(rows of doc_id and text, planted (doc_id, kind, start, end), lookalikes in the same form)."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    digit = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    number = lambda: f"{rng.choice('23456789')}{digit(2)}-{rng.choice('23456789')}{digit(2)}-{digit(4)}"
    odd_number = lambda: f"{rng.choice('01')}{digit(2)}-{rng.choice('01')}{digit(2)}-{digit(4)}"
    mac = lambda: ":".join("".join(rng.choice("0123456789abcdef") for _ in range(2)) for _ in range(6))
    person = lambda: f"{rng.choice(['Mr.', 'Dr.', 'Mrs.'])} {rng.choice(FIRST)} {rng.choice(LAST)}"
    street = lambda: f"{rng.randint(10, 999)} {rng.choice(['Oak', 'Mill', 'Harbor', 'Chapel'])} {rng.choice(['Street', 'Avenue', 'Road'])}"
    phone = lambda: f"+1 {number()}"
    good = [("number", number, ["call me at phone ", "my phone is ", "mobile: "]), ("id", lambda: f"{rng.choice('1234')}{digit(2)}-{rng.randint(10, 99)}-{digit(4)}", ["ssn: ", "social security number ", "passport or id "]), ("address", mac, ["mac address ", "device address "]), ("name", person, ["my name is ", "signed by ", "the patient called "]), ("street", street, ["she lives at ", "home address ", "deliver to "])]
    bad = [("number", odd_number, ["part ", "order ", "invoice ", "serial "]), ("id", lambda: f"000-00-{digit(4)}", ["order ", "part ", "ticket "]), ("name", lambda: f"{rng.choice(FIRST)} {rng.choice(['University', 'Award', 'Prize', 'Theorem'])}", ["the award of ", "a theorem of the "]), ("street", lambda: f"{rng.choice(['1984', '2001', '1976'])} {rng.choice(['Broadway', 'Harbor'])} {rng.choice(['Square', 'Terrace'])}", ["the novel ", "chapter of "])]
    rows, planted, alike = [], [], []
    for i in range(n):
        text = prose(rng.randint(5, 30)) + ", "
        for choices, into in rng.sample([(good, planted), (bad, alike)], k=1 if i % 5 else 0):
            kind, make, before = rng.choice(choices)
            text += rng.choice(before) if rng.random() < 0.85 else "and "
            what = make()
            into.append((i, kind, len(text), len(text) + len(what)))
            text += what + " " + prose(6)
            if into is planted and rng.random() < 0.7:
                text += f", or write to {rng.choice(WORDS)}@{rng.choice(WORDS)}.com"
        if i % 4 == 0:
            text += f", contact {phone()} or {rng.choice(WORDS)}.{rng.choice(WORDS)}@{rng.choice(WORDS)}.org"
        if i % 3 == 0:
            text += f", serial {digit(16)}"  # hardly ever a card
        rows.append((i, text))
    return rows, planted, alike


def pages(n=150, seed=8):
    """(html, main text) of pages of five layouts, two of which name none of their parts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS)

    def sentence():
        x = [word() for _ in range(rng.randint(6, 18))]
        x[rng.randint(1, 4)] += ","
        return " ".join(x).capitalize() + "."

    paragraph = lambda: " ".join(sentence() for _ in range(rng.randint(2, 6)))
    links = lambda tag, k: "".join(f"<{tag}><a href=/{word()}>{word()} {word()}</a></{tag}>" for _ in range(k))
    out = []
    for i in range(n):
        blocks = [("h1", " ".join(word() for _ in range(5)).title())]
        for _ in range(rng.randint(2, 6)):
            blocks.append(("p", paragraph()))
            if rng.random() < 0.3:
                blocks += [("li", word() + " " + word()) for _ in range(rng.randint(2, 4))]
            if rng.random() < 0.3:
                blocks += [("h2", word().title()), ("p", paragraph())]
        body = ""
        for k, (tag, text) in enumerate(blocks):
            ul = tag == "li" and (blocks[k - 1][0] != "li")
            end = tag == "li" and (k + 1 == len(blocks) or blocks[k + 1][0] != "li")
            name = ' class="notice-period"' if tag == "p" and rng.random() < 0.1 else ""
            body += "<ul>" * ul + f"<{tag}{name}>{text}</{tag}>" + "</ul>" * end
        script = f"<script src=/js/{word()}/>var x = 1, y = 2;</script>"
        comments = f"<div class='post-comments'><p>{paragraph()}</p><p>{paragraph()}</p></div>"
        advert = f"<div class=ad-box>{sentence()}</div>"
        layout = i % 5
        if layout == 0:
            page = f"<nav><ul>{links('li', 6)}</ul></nav>{advert}<article>{body}<section id=comments><p>{paragraph()}</p></section></article><footer>{word()}, {word()}.</footer>"
        elif layout == 1:
            page = f"<div id=top-menu>{links('span', 5)}</div><div class=content>{body}</div>{comments}<div class='sidebar widget'><p>{paragraph()}</p></div>"
        elif layout == 2:  # no names: links and lengths tell
            page = f"<div class=c1><ul>{links('li', 14)}</ul></div><div class=c2>{body}<div>{links('span', 8)}</div></div><div class=c3>{links('div', 9)}</div>"
        elif layout == 3:
            page = f"<table><tr><td>{links('div', 12)}</td><td>{body}</td></tr><tr><td colspan=2>{links('span', 4)}</td></tr></table>"
        else:
            page = f"<main><section>{body}</section>{comments}</main><div role=contentinfo>{sentence()}</div><div style='display: none'>{paragraph()}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{word()}</title>{script}</head><body>{script}{page}</body></html>", "\n".join(text for _, text in blocks)))
    return out
