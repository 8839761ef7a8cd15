"""Extraction by a language model, where templates find nothing: an interface and a stand-in."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dates import read_date
from tabulon.operators.validate import INVOICE_FIELDS, LINE_FIELDS, TAX_LINE_FIELDS

#: What is a number says so in the last word of its name, or it is a price, a rate, a quantity or a discount of a line.
_NUMERIC = frozenset("amount discount percent price qty quantity subtotal tax total unit untaxed".split())
_WORDS = frozenset("reference currency code".split())


class Provider(Protocol):
    """Gives the fields of a text by a JSON schema; must be picklable, as it runs in the workers."""

    name: str

    def available(self) -> bool: ...

    def extract(self, text: str, schema: Mapping[str, Any]) -> dict[str, Any]: ...


class Canned:
    """Answers with fixed fields; for tests."""

    name = "canned"

    def __init__(self, answer: Mapping[str, Any]) -> None:
        self.answer = dict(answer)

    def available(self) -> bool:
        return True

    def extract(self, text: str, schema: Mapping[str, Any]) -> dict[str, Any]:
        return {k: v for k, v in self.answer.items() if k in schema["properties"]}


class ChatEndpoint:
    """An HTTP service of the usual chat-completions form, asked for JSON at temperature zero."""

    name = "chat"

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 60) -> None:
        self.url, self.model, self.key, self.timeout = url.rstrip("/"), model, key, timeout

    def available(self) -> bool:
        return bool(self.url and self.model)

    def extract(self, text: str, schema: Mapping[str, Any]) -> dict[str, Any]:
        import json
        import urllib.request

        body = {
            "model": self.model, "temperature": 0, "response_format": {"type": "json_schema", "json_schema": {"name": "invoice", "schema": dict(schema)}},
            "messages": [{"role": "system", "content": "Give the document's fields as JSON."}, {"role": "user", "content": text}],
        }
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
            return json.loads(json.load(answer)["choices"][0]["message"]["content"])


#: Where vendors that speak this form are reached.
ENDPOINTS = {
    "openai": "https://api.openai.com/v1", "mistral": "https://api.mistral.ai/v1", "deepseek": "https://api.deepseek.com/v1",
    "gemini": "https://generativelanguage.googleapis.com/v1beta/openai", "ollama": "http://localhost:11434/v1",
}


@dataclass(frozen=True)
class Config:
    provider: str = "mock"
    model: str = ""
    url: str = ""
    key: str = ""


def load_config(environment: Mapping[str, str] = os.environ, prefix: str = "TABULON_AI_") -> Config:
    """Provider, model, address and key from the environment; a vendor's usual address where none is given, no provider means the stand-in."""
    given = {n: environment.get(f"{prefix}{n.upper()}", "") for n in ("provider", "model", "base_url", "api_key")}
    provider = given["provider"].lower() or "mock"
    return Config(provider, given["model"], given["base_url"] or ENDPOINTS.get(provider, ""), given["api_key"])


def get_provider(config: Config | None = None) -> Provider:
    """The stand-in for "mock", else the endpoint that the configuration names."""
    config = config or load_config()
    return Canned({}) if config.provider == "mock" else ChatEndpoint(config.url, config.model, config.key)


TEMPLATE_SCHEMA = {
    "type": "object", "required": ["issuer", "keywords", "fields"],
    "properties": {
        "issuer": {"type": "string"}, "keywords": {"type": "array", "items": {"type": "string"}}, "exclude_keywords": {"type": "array", "items": {"type": "string"}},
        "fields": {"type": "object", "additionalProperties": {"type": "object", "properties": {"parser": {"type": "string"}, "regex": {"type": "string"}, "type": {"type": "string"}}}},
    },
}


def draft_template(text: str, provider: Provider | None = None, issuer: str | None = None) -> dict[str, Any]:
    """A template by the provider for a sample text, which goes to it with the values that the labels and candidates show.

    Fields that don't parse are left out; issuer and keywords are the sample's own where none come.
    """
    from tabulon.operators import authoring
    from tabulon.sources.templates import TemplateError, make_template

    provider = provider or get_provider()
    own = authoring.draft_template(text, issuer)
    seen = [f"{name} = {value}" for name, value in authoring.preview(text, own).items() if value]
    given = provider.extract("\n".join(["Write extraction rules (one Python pattern with a group for each field) for this document:", text, *(["Values seen in it:"] if seen else []), *seen]), TEMPLATE_SCHEMA)
    keywords = given.get("keywords") or own["keywords"]
    made: dict[str, Any] = {"issuer": issuer or given.get("issuer") or own["issuer"], "keywords": [keywords] if isinstance(keywords, str) else list(keywords), "fields": {}}
    if given.get("exclude_keywords"):
        made["exclude_keywords"] = given["exclude_keywords"]
    for name, spec in (given["fields"] if isinstance(given.get("fields"), Mapping) else {}).items():
        try:
            make_template({**made, "fields": {name: spec}})
        except TemplateError:
            continue
        made["fields"][name] = spec
    return made


def json_schema() -> dict[str, Any]:
    """The vocabulary as a JSON schema: numbers by their names, all optional."""

    def kind(name: str) -> dict[str, str]:
        parts = name.split("_")
        return {"type": "number" if _NUMERIC & {parts[0], parts[-1]} and parts[-1] not in _WORDS else "string"}

    def rows(names: frozenset[str]) -> dict[str, Any]:
        return {"type": "array", "items": {"type": "object", "properties": {n: kind(n) for n in sorted(names)}}}

    plain = {n: kind(n) for n in sorted(INVOICE_FIELDS - {"lines", "tax_lines", "template_name"})}
    return {"type": "object", "properties": plain | {"lines": rows(LINE_FIELDS), "tax_lines": rows(TAX_LINE_FIELDS)}}


def cleaned(answer: Mapping[str, Any]) -> dict[str, Any]:
    """Without empty values; amounts as numbers where they are, dates as times where they can be read."""
    out = {}
    for k, v in answer.items():
        if v is None or v == "" or v == []:
            continue
        if k.startswith("amount"):
            try:
                v = float(v)
            except (TypeError, ValueError):
                continue
        elif k.startswith("date") and isinstance(v, str):
            v = read_date(v) or v
        out[k] = v
    return out


def fill_in(extracted: DataFrame, texts: DataFrame, provider: Provider, id_column: str = "doc_id") -> DataFrame:
    """Records by the provider for documents without one; ``extraction_method`` tells them apart.

    ``extracted`` is the engine's result, ``texts`` has the id and text. A failed call leaves the document as it was.
    """
    schema = json_schema()
    left = texts.join(extracted.where("record is null").select(id_column), id_column, "left_semi").select(id_column, "text")
    kind = left.schema[id_column].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    found = cleaned(provider.extract(text or "", schema)) if provider.available() and text else {}
                except Exception:  # noqa: BLE001 - a service's failure leaves the document as it was
                    found = {}
                out.append(json.dumps(found, default=lambda v: str(v).removesuffix(" 00:00:00")) if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_column, "answer"])

    answers = left.mapInArrow(ask, f"`{id_column}` {kind}, answer string")
    both = extracted.join(answers, id_column, "left")
    method = F.when(F.col("record").isNotNull(), "template").when(F.col("answer").isNotNull(), "ai")
    return both.withColumn("extraction_method", method).withColumn("record", F.coalesce("record", F.try_parse_json("answer"))).drop("answer")
