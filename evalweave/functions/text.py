"""Column builders for cleaning, hashing and naming. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters Unicode counts as white space when a string is stripped.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# What counts as a written number.
NUMBER_PATTERN = r"(?i)^([+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|[+-]?(inf|infinity))$"
# Allowed run names, and the parts of module and model names that carry meaning.
EXPERIMENT_ID_PATTERN = r"^[A-Za-z0-9._-]+$"
ROUTER_LAYER_PATTERN = r"(?:^|\.)layers\.(\d+)\.router$"
ROUTER_SUFFIX = ".router"
ENCODER_MARK = ".encoder."
DIFFUSION_MARK = "diffusion"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def clean_text(value: Column, *, is_float: bool = False) -> Column:
    """Stripped text; null (and NaN in a float column) becomes the empty string."""
    text = F.coalesce(strip(value.cast("string")), F.lit(""))
    return F.when(F.isnan(value), F.lit("")).otherwise(text) if is_float else text


def clean_float(value: Column, *, is_float: bool = False) -> Column:
    """A double, or null for null, blank, unparsable and NaN; infinities stay."""
    if is_float:
        return F.when(~F.isnan(value), value.cast("double"))
    text = strip(value.cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def example_seed(base_seed: int | Column, example_id: Column) -> Column:
    """A repeatable 31-bit seed per example.

    The seed is the first 64 bits of SHA-256("base:id") modulo 2^31, so only hex digits 9 to 16
    of the digest can matter.
    """
    base = base_seed.cast("string") if isinstance(base_seed, Column) else F.lit(str(base_seed))
    digest = F.sha2(F.concat(base, F.lit(":"), example_id), 256)
    low_word = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return low_word.bitwiseAND(F.lit(2**31 - 1))


def shuffle_key(seed: int, example_id: Column) -> Column:
    """Sort key of a seeded permutation that no partitioning can change."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), example_id), 256)


def model_kind(
    model_name: Column, *, diffusion: str = "diffusion", default: str = "autoregressive"
) -> Column:
    """Kind label by name; the two labels are the caller's to choose."""
    return F.when(F.lower(model_name).contains(DIFFUSION_MARK), F.lit(diffusion)).otherwise(
        F.lit(default)
    )


def model_subdir(model_name: Column) -> Column:
    return F.element_at(F.split(model_name, "/"), -1)


def processor_choice(model_name: Column, template_model: Column, template_processor: Column) -> Column:
    """The processor follows the model unless the template names its own."""
    return F.when(template_processor == template_model, model_name).otherwise(template_processor)


def valid_experiment_id(value: Column) -> Column:
    return value.rlike(EXPERIMENT_ID_PATTERN) & ~value.contains("\n")


def router_layer(module_name: Column, *, strict: bool = False) -> Column:
    """Layer number out of a router module name; null, or an error if strict, when there is none."""
    found = F.regexp_extract(module_name, ROUTER_LAYER_PATTERN, 1)
    layer = F.when(found != "", found.cast("int"))
    if not strict:
        return layer
    message = F.concat(F.lit("no router layer in "), module_name)
    return F.coalesce(layer, F.raise_error(message).cast("int"))


def is_router(module_name: Column) -> Column:
    return module_name.endswith(ROUTER_SUFFIX)


def canvas_router_phase(module_name: Column) -> Column:
    return F.when(module_name.contains(ENCODER_MARK), F.lit("encoder_prefill")).otherwise(
        F.lit("denoising")
    )


def decode_phase(forward_index: Column) -> Column:
    return F.when(forward_index == 0, F.lit("prefill")).otherwise(F.lit("autoregressive_decode"))


def render_single_turn(
    prompt: Column,
    template: str = "<user>\n{prompt}\n<model>\n",
    thinking: str | None = None,
) -> Column:
    """One user turn and the generation prompt, in a caller-supplied template.

    The template has a ``{prompt}`` slot and may have a ``{thinking}`` slot; one without it simply
    ignores the thinking mark.
    """
    head, slot, tail = template.replace("{thinking}", thinking or "").partition("{prompt}")
    if not slot:
        raise ValueError("the template has no {prompt} slot")
    return F.concat(F.lit(head), prompt, F.lit(tail))


def token_key(token_step: Column) -> Column:
    return F.format_string("token-%04d", token_step)


def canvas_key(canvas_index: Column, step_index: Column) -> Column:
    return F.format_string("canvas-%03d-step-%03d", canvas_index, step_index)
