"""A text model's calls: strict JSON, a few tries, and a limit on calls a minute in each task."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from .prompts import ADJUDICATE, ADJUDICATION_SCHEMA, EXTRACT, EXTRACTION_SCHEMA, candidate, conforms, passage

#: How the model is called, so that a call repeated gives the same.
TEMPERATURE, SEED, TRIES, CALLS_A_MINUTE = 0.0, 42, 3, 20


class JsonModel:
    """Wraps ``send(prompt, system, schema, temperature, seed)``; an answer that isn't JSON of the schema's form is asked
    for again. Without a schema any object will do."""

    def __init__(self, send: Callable[..., str], prompt: Callable, system: str | None = None, schema: dict | None = None, per_minute: float = CALLS_A_MINUTE, tries: int = TRIES, sleep=time.sleep, clock=time.monotonic):
        self.send, self.prompt, self.system, self.schema, self.tries = send, prompt, system, schema or {"type": "object", "properties": None}, tries
        self.gap, self.sleep, self.clock = 60.0 / per_minute if per_minute > 0 else 0.0, sleep, clock
        self.next = 0.0

    def __call__(self, item) -> str:
        problem: Exception | None = None
        for _ in range(self.tries):
            wait = self.next - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.next = self.clock() + self.gap
            try:
                raw = self.send(self.prompt(item), system=self.system, schema=self.schema, temperature=TEMPERATURE, seed=SEED)
                value = json.loads(raw)
                if not (conforms(value, self.schema) if self.schema["properties"] else isinstance(value, dict)):
                    raise ValueError("answer is not of the form asked for")
                return raw
            except (ValueError, ConnectionError, TimeoutError) as e:
                problem = e
        raise RuntimeError(f"no usable answer in {self.tries} tries: {problem}")


def extractor(send: Callable[..., str], **options) -> JsonModel:
    """Entities and triples of a passage."""
    return JsonModel(send, passage, EXTRACT, EXTRACTION_SCHEMA, **options)


def adjudicator(send: Callable[..., str], **options) -> JsonModel:
    """Whether an adjudication task's two names mean the same."""
    return JsonModel(send, candidate, ADJUDICATE, ADJUDICATION_SCHEMA, **options)
