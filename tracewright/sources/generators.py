"""Generators by name: an HTTP endpoint, hosted inference, or a model that each executor loads itself."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.pipeline import Answer, Messages, RunConfig, echo
from .endpoint import ChatEndpoint


@dataclass
class LocalModel:
    """A causal language model by the transformers library, loaded once in each Python worker. The access token is read on the
    executor from the environment variable `key`. A crash of the model is the error of its row.
    """

    model: str
    key: str | None = None
    temperature: float = 0.0
    max_tokens: int = 256
    device: str = "auto"
    options: dict = field(default_factory=dict)

    def _loaded(self):
        if "_held" not in self.__dict__:
            from transformers import AutoModelForCausalLM, AutoTokenizer

            token = os.environ.get(self.key or "")
            tokenizer = AutoTokenizer.from_pretrained(self.model, token=token)
            self._held = tokenizer, AutoModelForCausalLM.from_pretrained(self.model, token=token, device_map=self.device).eval()
        return self._held

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    @staticmethod
    def template(tokenizer, messages: Messages) -> str:
        """The messages in the model's own form, or one below the other where it has none."""
        if getattr(tokenizer, "chat_template", None):
            return tokenizer.apply_chat_template(messages, tokenize=False, add_generation_prompt=True)
        return "\n".join([*(f"[{m['role']}] {m['content']}" for m in messages), "[assistant]"])

    def __call__(self, messages: Messages) -> Answer:
        tokenizer, model = self._loaded()
        start = time.monotonic()
        given = tokenizer(self.template(tokenizer, messages), return_tensors="pt").to(model.device)
        prompt_n, prompt_ms = given["input_ids"].shape[1], (time.monotonic() - start) * 1000
        start = time.monotonic()
        drawn = {"do_sample": True, "temperature": self.temperature, "top_p": self.options.get("top_p", 1.0)} if self.temperature > 0 else {"do_sample": False}
        out = model.generate(**given, max_new_tokens=self.max_tokens, pad_token_id=tokenizer.eos_token_id, **drawn)[0][prompt_n:]
        predicted_n, predicted_ms = len(out), (time.monotonic() - start) * 1000
        usage = {"prompt_tokens": prompt_n, "completion_tokens": predicted_n, "total_tokens": prompt_n + predicted_n}
        for name, n, ms in (("prompt", prompt_n, prompt_ms), ("predicted", predicted_n, predicted_ms)):
            usage |= {f"{name}_n": n, f"{name}_ms": round(ms, 3), f"{name}_per_token_ms": round(ms / n, 6) if n else None, f"{name}_per_second": round(n / (ms / 1000), 2) if ms else None}
        return Answer(tokenizer.decode(out, skip_special_tokens=True), usage)


def _endpoint(cfg: RunConfig, url: str) -> ChatEndpoint:
    return ChatEndpoint(url, cfg.model, cfg.api_key_name, cfg.temperature, cfg.max_tokens, cfg.request_timeout)


#: From a run's `source` to its generator. `hosted` takes the base address of a service that speaks the chat protocol.
GENERATORS: dict[str, Callable[[RunConfig], Callable[[Messages], str | Answer]]] = {
    "echo": lambda cfg: echo,
    "local": lambda cfg: _endpoint(cfg, cfg.api_url),
    "hosted": lambda cfg: _endpoint(cfg, f"{cfg.api_url.rstrip('/')}/v1/chat/completions"),
    "model": lambda cfg: LocalModel(cfg.model, cfg.api_key_name, cfg.temperature, cfg.max_tokens),
}


def generator(cfg: RunConfig) -> Callable[[Messages], str | Answer]:
    """The generator of a run's source; its address is needed where it is reached over a network."""
    if cfg.source not in GENERATORS:
        raise ValueError(f"unknown source {cfg.source!r}: one of {', '.join(GENERATORS)}")
    if cfg.source in ("local", "hosted") and not cfg.api_url:
        raise ValueError(f"source {cfg.source!r} needs api_url")
    return GENERATORS[cfg.source](cfg)
