"""Fetching over the network, on the driver only; the opener is injected, so tests need no network."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable


class FetchError(RuntimeError):
    pass


def fetch_json(url: str, opener: Callable[[str], bytes], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Parsed answer; waits twice as long after every failed try."""
    for k in range(tries):
        try:
            return json.loads(opener(url))
        except (OSError, ValueError) as e:
            if k == tries - 1:
                raise FetchError(f"{url}: {e}") from e
            sleep(wait * 2**k)


def fetch_file(url: str, target: str, opener: Callable[[str], bytes], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Write the answer beside the target, then move it there."""
    for k in range(tries):
        try:
            content = opener(url)
            break
        except OSError as e:
            if k == tries - 1:
                raise FetchError(f"{url}: {e}") from e
            sleep(wait * 2**k)
    if not content:
        raise FetchError(f"{url}: empty answer")
    part = f"{target}.part"
    with open(part, "wb") as f:
        f.write(content)
    os.replace(part, target)
    return target


def catalogue(url: str, opener: Callable[[str], bytes], page_size: int = 2000) -> list[dict]:
    """All entries of a paged catalogue; their number must be the one the catalogue reports."""
    out, page = [], 1
    while True:
        answer = fetch_json(f"{url}&page_num={page}&page_size={page_size}", opener)
        out += answer["entries"]
        if len(out) >= answer["hits"] or not answer["entries"]:
            break
        page += 1
    if len(out) != answer["hits"]:
        raise FetchError(f"catalogue reports {answer['hits']} entries and gave {len(out)}")
    return out


def open_links(doi: str, mail: str, opener: Callable[[str], bytes]) -> dict:
    """Free copies of a publication: best link and all links, without the mail address in any error."""
    try:
        answer = fetch_json(f"https://api.unpaywall.org/v2/{doi}?email={mail}", opener)
    except FetchError as e:
        raise FetchError(str(e).replace(mail, "***")) from None
    places = answer.get("oa_locations") or []
    best = answer.get("best_oa_location") or {}
    return {"doi": doi, "free": bool(answer.get("is_oa")), "best": best.get("url_for_pdf") or best.get("url"), "links": [p["url"] for p in places if p.get("url")]}
