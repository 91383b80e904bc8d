"""URLs: keys for matching, validity of sources and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: What marks an image as no photo of a listing. Fixed values.
BLOCKED_IMAGE = r"logo|placeholder|no-image|noimage|sem-foto|semfoto|sem_foto|default|avatar|icon|sprite|banner|blank|loading|pixel|1x1|spacer|facebook|whatsapp|instagram"
IMAGE_END = r"\.(jpe?g|png|webp|gif|avif)([?#].*)?$"


def normalize_url(c: Column, keep_tracking: bool = False) -> Column:
    """Scheme and host in lower case (https where none is given), no fragment or
    trailing slash. Parameters stay in their order, without utm_*; with
    keep_tracking all stay, sorted. Blank gives null."""
    s = F.trim(c)
    s = F.when(s == "", None).when(s.startswith("//"), F.concat(F.lit("https:"), s)).when(s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    s = F.regexp_replace(s, "#.*$", "")
    head = F.lower(F.regexp_extract(s, r"^([A-Za-z]+://[^/?]+)", 1))
    path = F.regexp_replace(F.regexp_extract(s, r"^[A-Za-z]+://[^/?]+([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(s, r"\?(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & (F.lit(True) if keep_tracking else ~F.lower(p).startswith("utm_")))
    parts = F.array_sort(parts) if keep_tracking else parts
    return F.concat(head, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?:#]+)", 1)), r"^www\.", "")


def host_path(c: Column) -> Column:
    return F.concat(host(c), F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+$", ""))


def valid_source_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?://[^\s/]+\.[^\s]+$") & ~c.rlike("(?i)javascript:|mailto:|localhost|example\\.com"), F.lit(False))


def small_dimensions(c: Column, least: int = 200) -> Column:
    w, h = (F.regexp_extract(c, r"(\d{2,4})x(\d{2,4})", i).try_cast("int") for i in (1, 2))
    return F.coalesce((w < least) | (h < least), F.lit(False))


def blocked_image(c: Column) -> Column:
    """True for no image, and for logos, icons, placeholders and thumbnails."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (s == "") | s.rlike(BLOCKED_IMAGE) | s.startswith("data:") | s.rlike(r"\.svg([?#]|$)") | small_dimensions(s) | ~s.rlike("^(https?:)?//|^/")


def image_ok(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return ~blocked_image(c) & (s.rlike(IMAGE_END) | s.rlike("cdn|cloudfront|googleusercontent|amazonaws|/image|/foto|/img"))


#: Attributes that may hold an image's address; endings of images; hosts of images without one; what marks no photo. Fixed values.
IMAGE_ATTRIBUTES = "src|data-src|data-lazy|data-lazy-src|data-original|data-srcset|srcset|data-bg|data-background|data-image|data-img|data-url|data-full|data-zoom|data-large|data-high-res|content"
IMAGE_FILES = r"\.(jpg|jpeg|png|webp|gif|bmp|avif)$"
IMAGE_HOSTS = r"cloudinary\.com|imgix\.net|cdn\.|images\.|fotos?\.|photos?\."
NO_PHOTO = r"logo|icon|favicon|placeholder|loading|spinner|avatar|profile|banner|ad[s]?[_-]|tracking|pixel|spacer|transparent|blank|1x1|facebook|twitter|instagram|whatsapp|linkedin|youtube|google|analytics|cdn\..*\.(svg|ico)"


def page_images(html: Column, base: Column) -> Column:
    """Absolute image addresses of a page, as five methods find them, one after the
    other: img tags, attributes, addresses in the text, styles, and meta tags. Of
    those that differ in their queries only, the first stays; logos, icons and what
    is smaller than 100 by its name go."""
    found = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    image_like = lambda u: F.lower(F.substring_index(u, "?", 1)).rlike(IMAGE_FILES) | u.rlike(f"(?i){IMAGE_HOSTS}")
    meta = [r"property\s*=\s*[\"']og:image[\"'][^>]*?content\s*=\s*[\"']([^\"']+)[\"']", r"content\s*=\s*[\"']([^\"']+)[\"'][^>]*?property\s*=\s*[\"']og:image[\"']", r"(?:name|property)\s*=\s*[\"']twitter:image[\"'][^>]*?content\s*=\s*[\"']([^\"']+)[\"']"]
    methods = F.concat(
        found(r"(?is)<img\s+[^>]*?(?:src|data-src|data-lazy|data-original)\s*=\s*[\"']([^\"']+)[\"'][^>]*?>"), F.filter(found(rf"(?i)(?:{IMAGE_ATTRIBUTES})\s*=\s*[\"']([^\"']+)[\"']"), image_like),
        found(r"(?i)(https?://[^\s\"'<>)\]]+\.(?:jpg|jpeg|png|webp|gif|avif)(?:\?[^\s\"'<>)\]]*)?)"), F.filter(found(r"(?i)background(?:-image)?\s*:\s*url\s*\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)"), image_like),
        *(found(rf"(?is)<meta\s+[^>]*?{m}") for m in meta),
    )
    clean = F.transform(methods, lambda u: F.translate(F.trim(u), "\n\r\t", ""))
    absolute = F.transform(clean, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike("(?i)^https?://"), u).otherwise(absolute_url(u, base)))
    small = lambda u, i: F.coalesce(F.regexp_extract(u, r"[_-](\d+)x(\d+)\.", i).try_cast("int") < 100, F.lit(False))
    photos = F.filter(F.array_compact(absolute), lambda u: u.rlike("(?i)^https?://[^/?#]+") & ~u.rlike(f"(?i){NO_PHOTO}") & ~small(u, 1) & ~small(u, 2))

    def first_of_each(urls: Column) -> Column:
        keys = F.transform(urls, lambda u: F.substring_index(F.substring_index(u, "#", 1), "?", 1))
        return let(keys, lambda k: F.filter(urls, lambda u, i: F.array_position(k, F.get(k, i)) == i + 1))

    return let(photos, first_of_each)


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments; .. beyond the root is dropped."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(p))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def absolute_url(c: Column, base: Column) -> Column:
    """c seen from base, as browsers resolve it: absolute, without scheme, from
    the root, relative with . and .. segments, or a query or fragment alone."""
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    page = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), r"^[A-Za-z]+://[^/]+", "")
    page = F.when(page == "", "/").otherwise(page)
    s = F.trim(c)
    path, rest = F.regexp_extract(s, "^([^?#]*)", 1), F.regexp_extract(s, "^[^?#]*(.*)$", 1)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(page, "[^/]*$", ""), path))
    return (
        F.when(s.rlike("(?i)^[a-z][a-z0-9+.-]*:"), s).when(s.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), s))
        .when(s.startswith("?"), F.concat(root, page, s)).when((s == "") | s.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), s)).otherwise(F.concat(root, F.when(full.contains("/."), _without_dots(full)).otherwise(full), rest))
    )


def listing_id(url: Column) -> Column:
    """A lot number in the path or query, else the last segment of the path."""
    code = F.regexp_extract(url, r"(?i)(?:lote|imovel|id|hdnimovel)[/=-](\d+)", 1)
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""), "/"), -1)
    return F.when(code != "", code).otherwise(last)


def images_in(html: Column) -> Column:
    """Image addresses of a page, by tag, meta and style, sorted."""
    found = [F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (r'(?i)<img[^>]+?(?:data-)?src=["\']([^"\']+)', r'(?i)<meta[^>]+og:image["\'][^>]+content=["\']([^"\']+)', r'(?i)url\(["\']?([^"\')]+)', r'(?i)<source[^>]+srcset=["\']([^"\' ,]+)')]
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*found)), lambda u: ~blocked_image(u))))
