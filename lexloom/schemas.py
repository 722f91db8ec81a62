"""The relations that front ends produce and operators take."""

from __future__ import annotations

ENTITY_TYPES = ("Function", "Parameter", "Class", "Attribute", "Variable", "Decorator", "TypeAnnotation", "Interface", "TypeAlias", "Module")

IDENTIFIERS = "struct<name:string,entity_type:string,file:string,line:bigint,scope:string>"
DOC_TEXTS = "struct<file:string,line:bigint,text:string>"
PARAM = "struct<name:string,type_annotation:string,default:string>"
SIGNATURES = f"struct<name:string,params:array<{PARAM}>,return_type:string,decorators:array<string>,docstring_first_line:string,file:string,line:bigint,scope:string>"
BODIES = "struct<entity_name:string,scope:string,body_text:string,language:string,file:string,start_line:bigint,end_line:bigint>"
CLASSES = "struct<name:string,bases:array<string>,methods:array<string>,attributes:array<string>,docstring_first_line:string,file:string,line:bigint>"
CALL_SITES = "struct<caller_scope:string,callee:string,file:string,line:bigint>"
IMPORTS = "struct<source_module:string,imported_symbols:array<string>,alias:string,file:string,line:bigint>"
NESTING = "struct<file:string,node_id:bigint,parent_id:bigint,depth:bigint,kind:string,name:string,line:bigint>"

RELATIONS = {
    "identifiers": IDENTIFIERS, "doc_texts": DOC_TEXTS, "signatures": SIGNATURES, "bodies": BODIES, "classes": CLASSES,
    "call_sites": CALL_SITES, "imports": IMPORTS, "nesting": NESTING,
}
PARSED = "file string, language string, " + ", ".join(f"{k} array<{v}>" for k, v in RELATIONS.items())
EXTENSIONS = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust"}
CONVENTIONS = "kind string, value string, entity_type string, semantic_role string, examples array<string>, frequency bigint"
EDGES = "source string, target string, kind string, weight double"
