"""Schemas of files, chunks, pairs and runs."""

FILES = "path string, relative_path string, size bigint, extension string, is_binary boolean, content binary"
AST = "struct<symbol_type:string,name:string,parent:string,docstring:string,decorators:array<string>,imports:array<string>,node_type:string>"
SPAN = "struct<start_byte:bigint,end_byte:bigint,start_line:bigint,end_line:bigint,char_count:bigint>"
HIERARCHY = "struct<parent_id:string,children_ids:array<string>,depth:int,is_primary:boolean,is_extracted:boolean,lineage:array<string>,sibling_index:int>"
REPO_INFO = "map<string,string>"
METADATA = (
    "struct<file_type:string,config_keys:array<string>,dependencies:array<string>,chunk_index:int,total_lines:bigint,"
    "is_readme:boolean,is_license:boolean,doc_chunk_type:string,heading:string,heading_level:int,heading_path:string,"
    f"line_start:bigint,line_end:bigint,inferred_block:boolean,fenced_block:boolean,was_fenced_block:boolean,looks_executable:boolean,repo_info:{REPO_INFO}>"
)
CHUNKS = f"chunk_id string, file_path string, language string, chunk_type string, code string, ast {AST}, span {SPAN}, hierarchy {HIERARCHY}, metadata {METADATA}"
#: As exported: without lineage, sibling index, node type and character count.
EXPORTED_AST = AST.replace(",node_type:string", "")
EXPORTED_SPAN = SPAN.replace(",char_count:bigint", "")
EXPORTED_HIERARCHY = HIERARCHY.replace(",lineage:array<string>,sibling_index:int", "")
EXPORTED = f"chunk_id string, file_path string, language string, chunk_type string, code string, ast {EXPORTED_AST}, span {EXPORTED_SPAN}, hierarchy {EXPORTED_HIERARCHY}, metadata {METADATA}"
CHUNK_TYPES = ("module", "class", "function", "method", "context", "documentation", "configuration", "notebook", "script", "dockerfile", "typescript", "javascript", "text", "imports", "unknown")
RUN = "system string, qid string, docno string, score double, rank int"
QRELS = "qid string, docno string, relevance int"
