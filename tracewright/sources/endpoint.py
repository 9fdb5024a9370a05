"""A chat endpoint as a generator: one POST for each question, by the standard library alone."""

from __future__ import annotations

import base64
import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from ..operators.pipeline import Answer, Messages, TransientError, error_for

# Marks at which a model's turn ends, and what a caller may set beside temperature and length.
STOPS = ("<|im_end|>", "<|endoftext|>")
OPTIONS = ("top_p", "presence_penalty", "frequency_penalty", "seed")


@dataclass
class ChatEndpoint:
    """Callable on executors. The secret is read there from the environment variable `key`, as `user:password` for basic
    authentication or as a bearer token; it is no field, so it is neither shipped nor written out."""

    url: str
    model: str
    key: str | None = None
    temperature: float = 0.0
    max_tokens: int = 256
    timeout: float = 120.0
    stop: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    def _headers(self) -> dict[str, str]:
        headers, secret = {"Content-Type": "application/json"}, os.environ.get(self.key or "")
        if secret:
            basic = ":" in secret
            headers["Authorization"] = f"Basic {base64.b64encode(secret.encode()).decode()}" if basic else f"Bearer {secret}"
        return headers

    def __call__(self, messages: Messages) -> Answer:
        payload = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens, "stop": list(dict.fromkeys((*STOPS, *self.stop)))}
        payload |= {k: self.options[k] for k in OPTIONS if self.options.get(k) is not None}
        request = urllib.request.Request(self.url, json.dumps(payload).encode(), self._headers(), method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                body = response.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            raise error_for(e.code, e.read(300).decode("utf-8", "replace")) from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise TransientError(f"{self.url}: {e}") from e
        try:
            data = json.loads(body)
            text = data["choices"][0]["message"]["content"]
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise ValueError(f"unexpected response: {body[:300]}") from e
        known = {**(data.get("timings") or {}), **(data.get("usage") or {})}
        return Answer(text, {k: v for k, v in known.items() if k in Answer.USAGE})
