"""PDF files by a source of page elements, as a parser for the registry.

The source is a function of a path and its content that gives elements ({type, text, metadata}); it is
sent to the executors, where a service is called from each task.
"""

from __future__ import annotations

import json
import os
import urllib.request
import uuid
from collections.abc import Callable
from typing import Any

from siltstone.config import SettingsError
from siltstone.sources.files import Custom
from siltstone.sources.parsers.office import map_elements
from siltstone.sources.parsers.outline import Parsed, ParseError

STRATEGIES = ("vlm", "hi_res", "auto")


def pdf_parser(elements: Callable[[str, bytes], list[dict[str, Any]]], **about: Any) -> Custom:
    """A parser of `.pdf` files; add it to a registry with `prepend`."""

    def read(path: str, content: bytes) -> Parsed:
        found = elements(path, content)
        parsed = map_elements(found)
        parsed.extra |= about | {"element_count": len(found), "block_count": len(parsed.blocks)}
        return parsed

    return Custom("pdf_elements", (".pdf",), ("application/pdf",), read)


def remote_elements(url: str, strategy: str = "hi_res", key: str = "PDF_API_KEY", timeout: float = 300) -> Callable[[str, bytes], list[dict[str, Any]]]:
    """A source that posts each file to a partition service. The service's key is in an environment variable."""
    secret = os.environ.get(key, "")
    if not secret:
        raise SettingsError(f"a PDF service needs {key}")
    if strategy not in STRATEGIES:
        raise SettingsError(f"unknown strategy {strategy!r}")

    def call(path: str, content: bytes) -> list[dict[str, Any]]:
        edge = uuid.uuid4().hex
        head = f'--{edge}\r\nContent-Disposition: form-data; name="strategy"\r\n\r\n{strategy}\r\n'
        head += f'--{edge}\r\nContent-Disposition: form-data; name="files"; filename="{os.path.basename(path)}"\r\nContent-Type: application/pdf\r\n\r\n'
        body = head.encode() + content + f"\r\n--{edge}--\r\n".encode()
        asked = urllib.request.Request(url, body, {"Content-Type": f"multipart/form-data; boundary={edge}", "Authorization": f"Bearer {secret}"})
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as answer:
                return json.load(answer)
        except OSError as error:
            raise ParseError(f"the PDF service failed: {error}") from error

    return call
