"""Closed vocabularies and table schemas."""

from __future__ import annotations

#: Node types an extraction may give (fixed values).
NODE_TYPES = (
    "Feature Module Interface Signal Register RegisterField Scenario ClockDomain ResetDomain MemoryMap TestCase Parameter Product Instruction InstructionGroup "
    "AddressingMode Operand ArchitectureState PipelineStage FunctionalUnit Interrupt Exception MemoryRegion ShadowRegister CPU_Mode CLA_Task Peripheral Document "
    "Pin Package ElectricalSpec ApplicationDomain OrderingInfo Advisory Workaround SiliconRevision UsageNote Protocol ProtocolLayer TransactionType Channel "
    "MessageField StateMachine State Transition Function DataStructure Section BuildConfig CodeExample"
).split()

#: Relation types an extraction may give (fixed values).
REL_TYPES = (
    "IMPLEMENTS CONTAINS HAS_INTERFACE HAS_SIGNAL HAS_REGISTER HAS_FIELD REQUIRES VALIDATES BELONGS_TO AT_ADDRESS CONNECTS_TO DOCUMENTED_BY DRIVES DRIVEN_BY "
    "TIMING_PATH CLOCK_GATED_BY RESET_BY PARAMETERIZED_BY INSTANCE_OF ISA_HAS_INSTRUCTION INSTRUCTION_BELONGS_TO_GROUP INSTRUCTION_USES_MODE OPERAND_HAS_MODE "
    "INSTRUCTION_READS_REGISTER INSTRUCTION_WRITES_REGISTER INSTRUCTION_MODIFIES_STATE INSTRUCTION_EXECUTED_IN INTERRUPT_TRIGGERS EXCEPTION_RAISES "
    "STATE_HAS_REGISTER MODULE_IMPLEMENTS_INSTRUCTION HAS_PERIPHERAL PERIPHERAL_HAS_REGISTER CLA_HAS_TASK TASK_USES_INSTRUCTION MEMORY_MAPS_TO UNIT_EXECUTES "
    "STAGE_PRODUCES SUPERSEDES EXTENDS DEPENDS_ON CITES HAS_DOCUMENT HAS_MODULE HAS_PIN SIGNAL_ON_PIN HAS_SPEC TARGETS_APPLICATION HAS_PACKAGE "
    "HAS_ORDERING_INFO AFFECTS HAS_WORKAROUND CORRECTS APPLIES_TO_REVISION SUPERSEDED_BY DEFINES_TRANSACTION USES_CHANNEL CONTAINS_FIELD HAS_STATE "
    "TRANSITIONS_FROM TRANSITIONS_TO TRIGGERED_BY IMPLEMENTS_PROTOCOL LAYER_PART_OF DEFINED_IN_SECTION USES_CALLING_CONVENTION HAS_CODE_EXAMPLE "
    "REQUIRES_BUILD_CONFIG"
).split()

DOCUMENT_STATUSES = ("pending", "processing", "batch_submitted", "done", "failed")
BLOCK_STATUSES = ("pending", "embedded", "done", "failed")
STAGES = ("parse", "build", "submit", "ingest", "build_embed", "embed")

DOCUMENTS = "doc_id string, title string, source_path string, file_type string, total_pages int, chapters array<struct<title:string,start_page:int,end_page:int,level:int>>, extracted_at timestamp, file_hash string, status string"
CONTENT_BLOCKS = "id long, doc_id string, block_id string, content string, seq_index int, section_title string, content_hash string, status string, created_at timestamp"
HEADING_MAPS = "id long, doc_id string, heading_title string, heading_level int, parent_heading string, block_ids array<string>"
CONFLICT_LOGS = "id long, entity_type string, name string, property_key string, old_value string, new_value string, timestamp timestamp, doc_id string"
FEEDBACK = "id long, entity_type string, entity_name string, relation_from_type string, relation_from_name string, relation_to_type string, relation_to_name string, relation_type string, rating int, comment string, created_at timestamp"
USAGE_LOGS = "id long, session_id string, tool_name string, mode string, params string, vector_hits array<long>, entity_hits array<string>, relation_hits array<string>, flagged_items string, elapsed_ms int, created_at timestamp"
EVAL_QUESTIONS = "id long, dataset_name string, question string, ground_truth_answer string, ground_truth_context_ids array<long>, ground_truth_doc_ids array<string>, tags array<string>"
ENTITIES = "entity_type string, name string, properties map<string,string>, doc_properties map<string,map<string,string>>, source_doc_ids array<string>, source_chapter string, confidence double, verified boolean, created_at timestamp, updated_at timestamp, feedback_score long"
RELATIONS = "from_type string, from_name string, to_type string, to_name string, rel_type string, " + ENTITIES.split("name string, ", 1)[1]

#: A line of a results file, one answer a request.
RESULT_LINE = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>"
#: The JSON that an extraction answer holds.
EXTRACTION = "entities array<struct<type:string,name:string,properties:map<string,string>>>, relations array<struct<from_type:string,from_name:string,rel_type:string,to_type:string,to_name:string>>, image_descriptions array<struct<id:string,description:string>>"
