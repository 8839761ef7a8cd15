"""Readers: what turns a file into text. Each states whether it can run here and whether it takes an area."""

from __future__ import annotations

import hashlib
import html
import importlib.util
import re
import shutil
import subprocess
import tempfile
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.text import clean_reader_text

#: Tried in this order for files that aren't plain text, as far as they are available.
AUTOMATIC = ("pdfium", "pdftotext")
#: For documents that none of these makes a record of.
LAST_RESORTS = ("ocrmypdf", "tesseract")

Area = Mapping[str, float]


@dataclass(frozen=True)
class Reader:
    """``read(content, area)`` gives a text; ``available()`` says whether it can run on this machine; ``words(content)`` gives placed words."""

    name: str
    read: Callable[[bytes, Area | None], str]
    available: Callable[[], bool]
    takes_area: bool = False
    is_ocr: bool = False
    words: Callable[[bytes], list[dict]] | None = None


READERS: dict[str, Reader] = {}


def register_reader(reader: Reader) -> Reader:
    READERS[reader.name] = reader
    return reader


def _module(name: str) -> Callable[[], bool]:
    def there() -> bool:
        try:
            return importlib.util.find_spec(name) is not None
        except ModuleNotFoundError:  # of a package that it would lie in
            return False

    return there


def _programs(*names: str) -> Callable[[], bool]:
    return lambda: all(shutil.which(n) for n in names)


def _with_file(run: Callable[[str, Area | None], str], suffix: str) -> Callable[[bytes, Area | None], str]:
    def read(content: bytes, area: Area | None) -> str:
        with tempfile.NamedTemporaryFile(suffix=suffix if is_pdf(content) else ".png") as file:  # one document at a time, gone when it is read
            file.write(content)
            file.flush()
            return run(file.name, area)

    return read


def is_pdf(content: bytes) -> bool:
    return b"%PDF-" in content[:1024]


def _run(command: Sequence[str], given: bytes | None = None, timeout: float = 180) -> bytes:
    return subprocess.run(list(command), input=given, capture_output=True, timeout=timeout, check=True).stdout


def _pdftotext(content: bytes, area: Area | None) -> str:
    flags = [] if area is None else [x for k in "flrxyWH" for x in (f"-{k}", str(int(area[k])))]
    return _run([*"pdftotext -q -enc UTF-8 -layout".split(), *flags, "-", "-"], content).decode("utf-8", "replace")


_TAG = re.compile(r"<(page|word)\b([^>]*)>([^<]*)")


def words_of(markup: str) -> list[dict]:
    """Placed words of a bounding-box listing: page from 1, edges in points, text."""
    out, page = [], 0
    for kind, given, text in _TAG.findall(markup):
        if kind == "page":
            page += 1
            continue
        at = dict(re.findall(r"(\w+)=\"([^\"]*)\"", given))
        out.append({"page": page, **{k: float(at[n]) for k, n in (("x0", "xMin"), ("y0", "yMin"), ("x1", "xMax"), ("y1", "yMax"))}, "text": html.unescape(text)})
    return out


def _pdftotext_words(content: bytes) -> list[dict]:
    return words_of(_run("pdftotext -q -bbox-layout - -".split(), content).decode("utf-8", "replace"))


def _pdfium(content: bytes, area: Area | None) -> str:
    import pypdfium2

    document = pypdfium2.PdfDocument(content)
    pages = range(len(document)) if area is None else range(max(0, int(area["f"]) - 1), min(len(document), int(area["l"])))
    out = []
    for k in pages:
        page = document[k]
        text = page.get_textpage()
        if area is None:
            out.append(text.get_text_bounded())
            continue
        scale, height = 72.0 / area["r"], page.get_height()
        left, top = area["x"] * scale, height - area["y"] * scale
        out.append(text.get_text_bounded(left=left, bottom=top - area["H"] * scale, right=left + area["W"] * scale, top=top))
    return "\n".join(out)


def _pdfminer(content: bytes, area: Area | None) -> str:
    import io

    from pdfminer.high_level import extract_text
    from pdfminer.layout import LAParams

    return extract_text(io.BytesIO(content), laparams=LAParams(all_texts=True))


def _pdfplumber(content: bytes, area: Area | None) -> str:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as document:
        return "".join(p.extract_text(layout=True, x_tolerance=6, y_tolerance=4) or "" for p in document.pages)


def _hotpdf(path: str, area: Area | None) -> str:
    import hotpdf

    document = hotpdf.HotPdf(path)
    return "\n".join(document.extract_page_text(page=k) for k in range(len(document.pages)))


def _pdfoxide(path: str, area: Area | None) -> str:
    import pdf_oxide

    return pdf_oxide.PdfDocument(path).to_plain_text_all(preserve_layout=True)


def _tesseract(content: bytes, area: Area | None) -> str:
    """Pictures as they are, pages of a PDF as one tall picture; the page with its text layer goes through pdftotext, which knows areas."""
    if is_pdf(content):
        program = "magick" if shutil.which("magick") else "convert"
        content = _run([program, *"-density 350 -units PixelsPerInch pdf:- -alpha off -resample 300x300 -depth 8 -append png:-".split()], content)
    settings = "--psm 6 --oem 3 -c textonly_pdf=1 -c preserve_interword_spaces=1".split()
    return _pdftotext(_run(["tesseract", "stdin", "stdout", "-l", tesseract_languages(), *settings, "pdf"], content), area)


def tesseract_languages() -> str:
    """Installed languages joined with ``+``, by name."""
    listed = subprocess.run(["tesseract", "--list-langs"], capture_output=True, timeout=60, check=True).stdout.decode()
    return "+".join(sorted(x for x in listed.splitlines()[1:] if x and x != "osd"))


#: How ocrmypdf is called unless told otherwise, and what scans gain from besides.
OCR_OPTIONS = {"redo_ocr": True, "progress_bar": False}
SCAN_OPTIONS = {"redo_ocr": False, "force_ocr": True, "rotate_pages": True, "deskew": True, "clean": True, "optimize": 1}


def ocr_processed(content: bytes, options: Mapping[str, object] | None = None) -> bytes:
    """The PDF with a text layer, straightened and cleaned as the options say; RuntimeError where the program fails."""
    import ocrmypdf

    with tempfile.NamedTemporaryFile(suffix=".pdf") as given, tempfile.NamedTemporaryFile(suffix=".pdf") as made:
        given.write(content)
        given.flush()
        if code := ocrmypdf.ocr(given.name, made.name, **{**OCR_OPTIONS, **(options or {})}):
            raise RuntimeError(f"ocrmypdf ended with {code}")
        return made.read()


def ocrmypdf_reader(name: str = "ocrmypdf", **options: object) -> Reader:
    """A reader that calls ocrmypdf with options of one's own, such as ``**SCAN_OPTIONS``; register it to use it by name."""
    return Reader(name, lambda content, area: _pdftotext(ocr_processed(content, options), area), lambda: _module("ocrmypdf")() and _programs("pdftotext")(), takes_area=True, is_ocr=True)


@lru_cache(maxsize=1)
def _doctr_model():
    from doctr.models import ocr_predictor

    return ocr_predictor(pretrained=True)


def doctr_text(result) -> str:
    """A docTR result's lines; by its export where it cannot render itself."""
    if callable(getattr(result, "render", None)):
        return str(result.render())
    lines = (line for page in result.export().get("pages", ()) for block in page.get("blocks", ()) for line in block.get("lines", ()))
    return "\n".join(" ".join(word["value"] for word in line.get("words", ())) for line in lines)


def _doctr(content: bytes, area: Area | None) -> str:
    from doctr.io import DocumentFile

    return doctr_text(_doctr_model()(DocumentFile.from_pdf(content) if is_pdf(content) else DocumentFile.from_images([content])))


@lru_cache(maxsize=4)
def _paddle_model(language: str):
    from paddleocr import PaddleOCR

    return PaddleOCR(lang=language)


def paddle_text(result) -> str:
    """A PaddleOCR result's lines, of the mappings that newer versions give or the boxes with text and score of older ones."""
    out: list[str] = []
    for page in result or ():
        if isinstance(page, Mapping):
            out += map(str, page.get("rec_texts", ()))
        else:
            out += [str(found[1][0]) for found in page or () if isinstance(found, (list, tuple)) and len(found) > 1 and isinstance(found[1], (list, tuple)) and found[1]]
    return "\n".join(out)


def _pictures(content: bytes) -> list:
    """The pages of a PDF, or the picture itself, as arrays."""
    import io

    import numpy as np

    if not is_pdf(content):
        from PIL import Image

        return [np.array(Image.open(io.BytesIO(content)).convert("RGB"))]
    import pypdfium2

    document = pypdfium2.PdfDocument(content)
    try:
        return [document[k].render(scale=2).to_numpy() for k in range(len(document))]
    finally:
        document.close()


def paddleocr_reader(name: str = "paddleocr", language: str = "en") -> Reader:
    """PaddleOCR for a language; one model for each worker."""
    return Reader(name, lambda content, area: "\n".join(filter(None, (paddle_text(_paddle_model(language).ocr(x)) for x in _pictures(content)))), _module("paddleocr"), is_ocr=True)


@lru_cache(maxsize=1)
def _vision_client():
    from google.cloud import vision

    return vision.ImageAnnotatorClient()


def vision_text(response) -> str:
    """The text of all pages of a Cloud Vision answer."""
    return "\n".join(page.full_text_annotation.text for file in response.responses for page in (getattr(file, "responses", None) or [file]))


def _gvision(content: bytes, area: Area | None) -> str:
    """Sent with the request itself, so no bucket is needed; credentials are the client library's own."""
    feature = {"type_": "DOCUMENT_TEXT_DETECTION"}
    if is_pdf(content):
        return vision_text(_vision_client().batch_annotate_files(requests=[{"input_config": {"content": content, "mime_type": "application/pdf"}, "features": [feature]}]))
    return vision_text(_vision_client().batch_annotate_images(requests=[{"image": {"content": content}, "features": [feature]}]))


def _plain(content: bytes, area: Area | None) -> str:
    return content.decode("utf-8", "replace")


for _reader in (
    Reader("text", _plain, lambda: True), Reader("pdfium", _pdfium, _module("pypdfium2"), takes_area=True),
    Reader("pdftotext", _pdftotext, _programs("pdftotext"), takes_area=True, words=_pdftotext_words),
    Reader("pdfminer", _pdfminer, _module("pdfminer")), Reader("pdfplumber", _pdfplumber, _module("pdfplumber")), Reader("pdfoxide", _with_file(_pdfoxide, ".pdf"), _module("pdf_oxide")),
    Reader("hotpdf", _with_file(_hotpdf, ".pdf"), _module("hotpdf")),
    Reader("tesseract", _tesseract, lambda: _programs("tesseract", "pdftotext")() and (_programs("magick")() or _programs("convert")()), takes_area=True, is_ocr=True),
    ocrmypdf_reader(), Reader("gvision", _gvision, _module("google.cloud.vision"), is_ocr=True), Reader("doctr", _doctr, _module("doctr"), is_ocr=True), paddleocr_reader(),
):
    register_reader(_reader)


def available_readers() -> list[str]:
    return [name for name, reader in READERS.items() if reader.available()]


def resolve(path: str, name: str | None = None) -> list[str]:
    """Readers to try on a file, in order: the named one (KeyError if unknown), text for .txt, else the automatic ones that are there."""
    if name is not None:
        return [READERS[name].name]
    if path.lower().endswith(".txt"):
        return ["text"]
    return [n for n in AUTOMATIC if READERS[n].available()] or ["pdftotext"]


#: Texts that a worker remembers, by reader, content and area.
REMEMBERED = 64


def remembering(read: Callable[[Reader, bytes, Area | None], object]) -> Callable[[Reader, bytes, Area | None], object]:
    """The same, but what was just read isn't read again: templates may ask for one area more than once."""
    known: OrderedDict[tuple, object] = OrderedDict()

    def of(reader: Reader, content: bytes, area: Area | None) -> object:
        key = (reader.name, hashlib.blake2b(content, digest_size=16).digest(), tuple(sorted(area.items())) if area else None)
        if key not in known:
            known[key] = read(reader, content, area)
            while len(known) > REMEMBERED:
                known.popitem(last=False)
        known.move_to_end(key)
        return known[key]

    return of


_BOXES = "array<struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string>>"


def reader_texts(files: DataFrame, readers: Sequence[str], content_column: str = "content", area: Area | None = None, boxes: bool = False) -> DataFrame:
    """Each file's text by each reader: adds ``reader``, ``reader_rank``, ``text`` ("" where a reader fails) and ``read_error``.

    An area asked of a reader that takes none is an error of that reader's rows. With ``boxes`` the
    placed words are added in a column of this name, null where a reader has none.
    """
    every = files.crossJoin(F.broadcast(files.sparkSession.createDataFrame(list(enumerate(readers)), "reader_rank int, reader string")))  # a row per reader
    at, which = every.columns.index(content_column), every.columns.index("reader")
    places = [k for k, c in enumerate(every.columns) if c != content_column]
    out = [every.columns[k] for k in places]
    known = {n: READERS[n] for n in readers}
    wanted = dict(area) if area else None
    shape = ", ".join(f"`{c}` {every.schema[c].dataType.simpleString()}" for c in out)
    kind = pa.list_(pa.struct([("page", pa.int32()), *[(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")], ("text", pa.string())]))

    def read(reader: Reader, content: bytes, area: Area | None) -> tuple[str, list[dict] | None]:
        return reader.read(content, area), reader.words(content) if boxes and reader.words else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = remembering(read)
        for batch in batches:
            texts, errors, words = [], [], []
            for content, name in zip(batch.column(at), batch.column(which).to_pylist()):
                try:
                    reader = known[name]
                    if wanted and not reader.takes_area:
                        raise ValueError(f"{name} takes no area")
                    text, own = once(reader, content.as_py() or b"", wanted)
                    texts.append(text)
                    words.append(own)
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - any failure of a reader leaves the next one's turn
                    texts.append("")
                    words.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:500])
            kept = [batch.column(k) for k in places]
            made = [pa.array(texts, pa.string()), pa.array(errors, pa.string()), *([pa.array(words, kind)] if boxes else [])]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*out, "text", "read_error", *(["boxes"] if boxes else [])])

    found = every.mapInArrow(run, f"{shape}, text string, read_error string" + (f", boxes {_BOXES}" if boxes else ""))
    return found.withColumn("text", clean_reader_text(F.col("text")))


def read_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as ``path`` and ``content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``doc_id`` (the path) and ``text``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("doc_id"), clean_reader_text(F.col("value")).alias("text"))


def area_text(text: Column, cropped: Column) -> Column:
    """The cropped text where there is one, else the whole."""
    return F.coalesce(cropped, text)
