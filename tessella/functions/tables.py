"""Fixed values of the style domain, as the CSS specifications and the reference's behaviour state them."""

# Properties that inherit (custom properties do too).
INHERITED = """azimuth border-collapse border-spacing caption-side color cursor direction empty-cells font-family
font-feature-settings font-kerning font-size font-size-adjust font-stretch font-style font-variant font-variant-caps
font-variant-numeric font-weight hyphens letter-spacing line-height list-style-image list-style-position
list-style-type orphans overflow-wrap quotes tab-size text-align text-align-last text-decoration-color text-indent
text-justify text-rendering text-shadow text-transform text-underline-position visibility white-space widows
word-break word-spacing writing-mode -webkit-font-smoothing""".split()

# Properties by which an element paints, and values by which it does not.
SIDES = ("top", "right", "bottom", "left")
CORNERS = ("top-left", "top-right", "bottom-right", "bottom-left")
VISUAL = """background background-color background-image
border-top-width border-right-width border-bottom-width border-left-width
border-top-style border-right-style border-bottom-style border-left-style
border-top-color border-right-color border-bottom-color border-left-color
border-top-left-radius border-top-right-radius border-bottom-right-radius border-bottom-left-radius
box-shadow outline outline-width outline-style outline-color
text-shadow filter backdrop-filter mix-blend-mode opacity""".split()
PAINTLESS = ("none", "0", "normal", "transparent", "rgba(0, 0, 0, 0)", "initial", "unset", "auto")

# Units that a zero does without, units that depend on the parent's font, colour functions.
ZERO_UNITS = "px em rem ex ch vh vw vmin vmax vi vb pt pc cm mm in q lh rlh fr deg rad turn s ms".split()
RELATIVE_UNITS = "em ex ch lh".split()
COLOUR_FUNCTIONS = "rgb rgba hsl hsla hwb lab lch oklab oklch".split()
TRANSPARENT = "rgba(0, 0, 0, 0)"
#: The parts of a CSS value, for Python and Java alike: calls of colour functions, hexadecimal colours,
#: words (numbers with their units among them), white space, and any other character.
CALL = r"(?i:(?<![A-Za-z0-9_])(?:" + "|".join(COLOUR_FUNCTIONS) + r")\([^()]*\))"
PARTS = r"#[0-9A-Za-z_]+|[0-9A-Za-z_]+|\s+|[^\s0-9A-Za-z_]"

# Properties that a React style takes as bare numbers.
UNITLESS = """animation-iteration-count aspect-ratio border-image-outset border-image-slice border-image-width box-flex
box-flex-group box-ordinal-group column-count columns flex flex-grow flex-shrink font-weight grid-area grid-column
grid-column-end grid-column-start grid-row grid-row-end grid-row-start line-clamp line-height opacity order orphans
tab-size widows z-index zoom fill-opacity flood-opacity stop-opacity stroke-dasharray stroke-dashoffset
stroke-miterlimit stroke-opacity stroke-width""".split()

# Shorthands and their longhands.
FOUR_SIDED = {
    "padding": [f"padding-{s}" for s in SIDES],
    "margin": [f"margin-{s}" for s in SIDES],
    "inset": list(SIDES),
    "scroll-margin": [f"scroll-margin-{s}" for s in SIDES],
    "scroll-padding": [f"scroll-padding-{s}" for s in SIDES],
    "border-width": [f"border-{s}-width" for s in SIDES],
    "border-style": [f"border-{s}-style" for s in SIDES],
    "border-color": [f"border-{s}-color" for s in SIDES],
    "border-radius": [f"border-{c}-radius" for c in CORNERS],
}
TWO_AXES = {
    "overflow": ["overflow-x", "overflow-y"],
    "overscroll-behavior": ["overscroll-behavior-x", "overscroll-behavior-y"],
    "place-items": ["align-items", "justify-items"],
    "place-content": ["align-content", "justify-content"],
    "place-self": ["align-self", "justify-self"],
    "gap": ["row-gap", "column-gap"],
    "grid-gap": ["row-gap", "column-gap"],
}
ONE_VALUE = {
    "padding-inline": ["padding-left", "padding-right"],
    "padding-block": ["padding-top", "padding-bottom"],
    "margin-inline": ["margin-left", "margin-right"],
    "margin-block": ["margin-top", "margin-bottom"],
    "inset-inline": ["left", "right"],
    "inset-block": ["top", "bottom"],
    "scroll-padding-inline": ["scroll-padding-left", "scroll-padding-right"],
    "scroll-padding-block": ["scroll-padding-top", "scroll-padding-bottom"],
    "scroll-margin-inline": ["scroll-margin-left", "scroll-margin-right"],
    "scroll-margin-block": ["scroll-margin-top", "scroll-margin-bottom"],
}

# Selector vocabulary.
STRUCTURAL = {":nth-child", ":nth-last-child", ":first-child", ":last-child", ":only-child", ":nth-of-type", ":nth-last-of-type", ":first-of-type", ":last-of-type", ":only-of-type"}
FUNCTIONAL = {":not", ":is", ":where", ":has", ":matches"}
LEGACY_ELEMENTS = {":before", ":after", ":first-line", ":first-letter"}

# Markup vocabulary.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = {"script", "style", "template", "svg", "pre", "textarea"}
