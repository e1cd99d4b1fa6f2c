"""Fixed values that results depend on."""

# Feature-name prefixes of control probes (case-sensitive).
CONTROL_PREFIXES = (
    "NegControlProbe_",
    "NegControlCodeword_",
    "BLANK_",
    "Blank-",
    "antisense_",
    "Unassigned",
)

# Line prefixes that one gene-list format uses for its header.
GENE_LIST_HEADER_PREFIXES = ("Efficiently", "Total", "Detection", "Samples")

# Platform codes.
PLATFORM_CODES = {"visium": 0, "xenium": 1}

# Order of network stages in the layer report.
STAGE_ORDER = ("stem", "layer1", "layer2", "layer3", "layer4", "pooled_backbone", "projected", "final_embedding")

# Morphology columns, in order, of the hand-made feature vector.
MORPHOLOGY_COLUMNS = (
    "area_um2",
    "perimeter_um",
    "bbox_width_um",
    "bbox_height_um",
    "aspect_ratio",
    "fill_ratio",
    "equivalent_diameter_um",
    "crop_r_mean",
    "crop_g_mean",
    "crop_b_mean",
    "crop_r_std",
    "crop_g_std",
    "crop_b_std",
    "gray_mean",
    "gray_std",
    "gradient_mean",
    "gradient_std",
)

# Numeric floors and scales.
NORM_FLOOR = 1e-12      # vector norms and Pearson denominators
RATIO_FLOOR = 1e-6      # shape ratios, pixel sizes, temperatures
TRANSPORT_FLOOR = 1e-8  # kernel, scaling and mass floor of the transport cost
CPM_SCALE = 1e6
CP10K_SCALE = 1e4
