"""HTTP clients of feeds, pages, a chat model and a message service. Tasks get them with functools.partial."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

# What the model is told besides the article.
SYSTEM = "You summarize AI news for a Telegram digest. Return exactly 3 concise sentences."
AGAIN = "Rewrite your answer as exactly 3 sentences."


def _text(response) -> str:
    return response.read().decode(response.headers.get_content_charset() or "utf-8", "replace")


def fetch_feed(url: str, user_agent: str, timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as response:
        return _text(response)


def fetch_page(url: str, send_agent: bool, user_agent: str, timeout: float) -> tuple[str, str, str]:
    """The url it came from after redirects, its content type, its text (of HTML only)."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": user_agent} if send_agent else {}), timeout=timeout) as response:
        kind = response.headers.get("Content-Type", "")
        return response.geturl(), kind, _text(response) if "text/html" in kind else ""


def _post(url: str, payload: dict, headers: dict[str, str], timeout: float) -> tuple[int, dict]:
    """Status and JSON answer; a refusal answers too."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.status, json.loads(response.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def ask_model(prompt: str, again: bool, base_url: str, key: str, model: str, site: str | None, app: str | None, timeout: float) -> str:
    headers = {"Authorization": f"Bearer {key}", **({"HTTP-Referer": site} if site else {}), **({"X-Title": app} if app else {})}
    said = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}, *([{"role": "user", "content": AGAIN}] if again else [])]
    status, answer = _post(f"{base_url}/chat/completions", {"model": model, "messages": said, "temperature": 0.2, "max_tokens": 220}, headers, timeout)
    if not 200 <= status < 300:
        raise OSError(f"the model's service answers {status}")
    return str(answer["choices"][0]["message"]["content"])


def post_message(method: str, payload: dict, base_url: str, token: str, timeout: float) -> tuple[int, dict]:
    return _post(f"{base_url}/bot{token}/{method}", payload, {}, timeout)
