from tonelake.functions.scalar import (  # noqa: F401
    binarize_label,
    cents_similarity,
    file_key,
    forgetting_similarity,
    is_in_interval,
    mean_pool,
    octave_similarity,
    octave_to_hz,
    remap_map,
    remap_replace,
    round_half_even,
    slice_chars,
    unvoice,
    zero_pad_id,
)
