"""Values that results depend on, as they are. The API whose code and documentation is chunked names its classes with PREFIX."""

PREFIX = "vtk"

# Last word of an action phrase and the verb that it stands for.
VERBS = {
    "creation": "create", "generation": "generate", "reading": "read", "writing": "write", "rendering": "render",
    "display": "display", "visualization": "visualize", "computation": "compute", "calculation": "calculate",
    "estimation": "estimate", "evaluation": "evaluate", "analysis": "analyze", "comparison": "compare",
    "extraction": "extract", "conversion": "convert", "transformation": "transform", "interpolation": "interpolate",
    "resampling": "resample", "smoothing": "smooth", "filtering": "filter", "clipping": "clip", "cutting": "cut",
    "merging": "merge", "partitioning": "partition", "tessellation": "tessellate", "deformation": "deform",
    "manipulation": "manipulate", "representation": "represent", "management": "manage", "storage": "store",
    "removal": "remove", "processing": "process", "handling": "handle", "grouping": "group", "mapping": "map",
    "placement": "place", "location": "locate", "probing": "probe", "iteration": "iterate", "traversal": "traverse",
    "selection": "select", "picking": "pick", "drawing": "draw", "plotting": "plot", "exporting": "export",
    "importing": "import", "encoding": "encode", "decoding": "decode", "serialization": "serialize",
    "deserialization": "deserialize", "compression": "compress", "integration": "integrate",
    "synchronization": "synchronize", "communication": "communicate", "execution": "execute",
    "interaction": "interact with", "definition": "define", "specification": "specify",
    "implementation": "implement", "construction": "construct", "modification": "modify", "adjustment": "adjust",
    "alignment": "align", "orientation": "orient", "positioning": "position", "layout": "layout", "access": "access",
    "control": "control", "extrusion": "extrude", "decimation": "decimate", "reduction": "reduce",
    "subdivision": "subdivide", "triangulation": "triangulate", "simplification": "simplify",
    "thresholding": "threshold", "slicing": "slice", "splitting": "split", "casting": "cast", "sorting": "sort",
    "collection": "collect", "aggregation": "aggregate", "distribution": "distribute",
    "decomposition": "decompose", "appending": "append", "caching": "cache", "sampling": "sample",
    "tracking": "track", "detection": "detect", "measurement": "measure", "assignment": "assign",
    "parsing": "parse", "reflection": "reflect",
}

# First words that take no article.
MASS_NOUNS = ("data", "information", "output", "input", "metadata", "geometry", "content", "storage", "memory", "hardware", "software")
ARTICLES = ("a", "an", "the")

# Methods that describe no configuration.
LIFECYCLE_METHODS = ("Update", "Initialize", "Render", "Start", "Modified", "Delete", "ShallowCopy", "DeepCopy", "Execute", "Finalize", "Allocate", "Release")

# Fixed values, in order of precedence: method prefix, verb, article, preposition of the question, and participle of the phrase.
METHOD_PREFIXES = (
    ("Set", "set", "the", "of", "set to"),
    ("Add", "add", "a", "to", "added"),
    ("Remove", "remove", "a", "from", "removed"),
    ("Create", "create", "a", "for", "created"),
    ("Clear", "clear", "the", "of", "cleared"),
    ("Reset", "reset", "the", "of", "reset"),
    ("Build", "build", "the", "of", "built"),
    ("Compute", "compute", "the", "of", "computed"),
)
METHOD_SUFFIXES = (("On", "enable", "enabled"), ("Off", "disable", "disabled"))

# First parts of function names that are actions.
FUNCTION_ACTIONS = (
    "make", "create", "build", "setup", "get", "generate", "compute", "calculate", "init", "initialize", "load", "read", "write",
    "save", "render", "draw", "add", "set", "update", "convert", "transform", "apply", "process", "extract", "filter",
)

# Props that behave like actors though they aren't named so.
ACTOR_LIKE = frozenset((
    "vtkVolume", "vtkMultiVolume", "vtkImageSlice", "vtkImageStack", "vtkFollower", "vtkAxisFollower", "vtkProp3DFollower",
    "vtkProp3DAxisFollower", "vtkFlagpoleLabel", "vtkAssembly", "vtkPropAssembly", "vtkLODProp3D", "vtkAxesGrid", "vtkAvatar",
))

# Class of a property that is only used inline, by the class of its parent. Only these parents can be found; the
# mapping that results must match names each parent with further property classes that its look-up never reaches.
INLINE_PROPERTY = {
    "vtkActor": "vtkProperty", "vtkVolume": "vtkVolumeProperty", "vtkImageSlice": "vtkImageProperty",
    "vtkActor2D": "vtkProperty2D", "vtkTextActor": "vtkTextProperty",
}

# Methods that give an object its property.
PROPERTY_SETTERS = frozenset((
    "SetProperty", "SetBackfaceProperty", "SetShaderProperty", "SetImageProperty", "SetTextProperty", "SetTitleTextProperty",
    "SetLabelTextProperty", "SetCaptionTextProperty", "SetAxisLabelTextProperty", "SetAxisTitleTextProperty",
    "SetAxesTextProperty", "SetDefaultTextProperty", "SetEdgeLabelTextProperty", "SetVertexLabelTextProperty",
    "SetHandleProperty", "SetSelectedHandleProperty", "SetSelectedProperty", "SetHoveringProperty", "SetSelectingProperty",
    "SetLineProperty", "SetSelectedLineProperty", "SetFrameProperty", "SetPlaneProperty", "SetEnvironmentTextureProperty",
))

# Methods that return an object's property.
PROPERTY_GETTERS = frozenset((
    "GetProperty", "GetVolumeProperty", "GetImageProperty", "GetProperty2D", "GetBackfaceProperty", "GetShaderProperty",
    "GetTextProperty", "GetLabelTextProperty", "GetTitleTextProperty", "GetCaptionTextProperty", "GetLabelProperty",
    "GetHandleProperty", "GetSelectedHandleProperty", "GetSelectedProperty", "GetActiveProperty", "GetOutlineProperty",
    "GetSelectedOutlineProperty", "GetLineProperty", "GetSelectedLineProperty", "GetBorderProperty", "GetEdgesProperty",
    "GetPlaneProperty", "GetSelectedPlaneProperty", "GetNormalProperty", "GetSelectedNormalProperty", "GetFaceProperty",
    "GetSelectedFaceProperty", "GetAxisProperty", "GetSelectedAxisProperty", "GetSphereProperty", "GetSelectedSphereProperty",
    "GetSliderProperty", "GetTubeProperty",
))

# Other methods whose results are used in chained calls.
OTHER_GETTERS = frozenset((
    "GetMapper", "GetLookupTable", "GetActiveCamera", "GetRenderWindow", "GetInteractorStyle", "GetRenderer",
    "GetCurrentRenderer", "GetDefaultRenderer", "GetInteractor", "GetPointData", "GetCellData", "GetFieldData", "GetScalars",
    "GetVectors", "GetTensors", "GetArray", "GetPoints", "GetTransform", "GetMatrix", "GetInformation", "GetBlock",
    "GetXAxesLinesProperty", "GetYAxesLinesProperty", "GetZAxesLinesProperty", "GetXAxisCaptionActor2D",
    "GetYAxisCaptionActor2D", "GetZAxisCaptionActor2D", "GetTextActor",
))

# Imports for their side effects.
RENDERING_IMPORT, INTERACTION_IMPORT = "import vtkmodules.vtkRenderingOpenGL2", "import vtkmodules.vtkInteractionStyle"
