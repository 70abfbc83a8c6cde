"""Data contract: field names and types of the JSON documents."""

# The optional arguments an instruction may carry.
ARG_TYPES = {
    "language": "string",
    "num_sentences": "double",
    "relation": "string",
    "num_placeholders": "double",
    "num_bullets": "double",
    "starter": "string",
    "num_highlights": "double",
    "section_spliter": "string",
    "num_sections": "double",
    "num_paragraphs": "double",
    "postscript_marker": "string",
    "original_message": "string",
    "keywords": "array<string>",
    "keyword": "string",
    "frequency": "double",
    "num_words": "double",
    "nth_paragraph": "double",
    "first_word": "string",
    "key_sentences": "array<string>",
    "forbidden_words": "array<string>",
    "original_paragraph": "string",
    "low": "double",
    "high": "double",
    "prompt_to_repeat": "string",
    "end_phrase": "string",
    "letter": "string",
    "let_frequency": "double",
    "let_relation": "string",
    "capital_frequency": "double",
    "capital_relation": "string",
}


# A number may be written as 2, 2.0 or 2.5; texts are no numbers.
NUMBERS = [name for name, kind in ARG_TYPES.items() if kind == "double"]


def args_ddl(extra=None):
    return ", ".join(f"`{k}` {t}" for k, t in {**ARG_TYPES, **(extra or {})}.items())


GENERATION_CONFIG = (
    "struct<max_new_tokens:int,temperature:double,top_p:double,top_k:int,"
    "repetition_penalty:double,do_sample:boolean,use_cache:boolean>"
)

# `kwargs array<string>`: the JSON reader keeps the raw text of an element, be
# it a JSON string or an object.
SAMPLE = (
    "struct<key:bigint,prompt:string,response:string,"
    "instruction_id_list:array<string>,kwargs:array<string>>"
)

RUN_CONFIG = (
    "struct<model_name:string,lora_path:string,precision:string,max_seq_length:int,"
    f"batch_size:int,generation_config:{GENERATION_CONFIG},chat_template:string,loader:string>"
)

RUN_METADATA = (
    "struct<run_name:string,timestamp:string,num_samples:bigint,"
    "generation_time_seconds:double,gpu_memory_gb:double>"
)

RESPONSES_DOCUMENT = (
    f"config {RUN_CONFIG}, metadata {RUN_METADATA}, samples array<{SAMPLE}>"
)

ACCURACIES = (
    "struct<inst_level_strict_acc:double,inst_level_loose_acc:double,"
    "prompt_level_strict_acc:double,prompt_level_loose_acc:double>"
)

RESULT_DOCUMENT = (
    "metadata struct<model_name:string,lora_path:string,precision:string,run_name:string,"
    "timestamp:string,tasks:array<string>,eval_gpu_memory_gb:double>, "
    f"config struct<max_seq_length:int,batch_size:int,generation_config:{GENERATION_CONFIG},"
    "chat_template:string,num_samples:bigint>, "
    "timing struct<generation_seconds:double,scoring_seconds:double,total_seconds:double>, "
    f"results struct<ifeval:{ACCURACIES}>, "
    "metrics_flat map<string,double>, "
    "training_metadata struct<dataset_samples:bigint,epochs:double,learning_rate:double,"
    "training_time_seconds:double,training_loss:double,peak_gpu_memory_gb:double,"
    "training_samples_per_second:double>"
)

MMLU_DOCUMENT = (
    "results struct<tinyMMLU:struct<`acc_norm,none`:double>>, "
    "configs struct<tinyMMLU:struct<metadata:struct<dtype:string>>>, "
    "`n-samples` struct<tinyMMLU:struct<effective:bigint>>, "
    "config struct<batch_size:string,model_dtype:string>, "
    "model_name string, total_evaluation_time_seconds string"
)

TRAINING_METADATA = (
    "base_model string, precision string, dataset string, samples bigint, loss double, "
    "steps bigint, runtime_s double, peak_gpu_gb double, lora_r int, timestamp string"
)

BENCHMARK_ROW = (
    "key bigint, prompt string, instruction_id_list array<string>, kwargs array<string>"
)

INSTRUCTION_ROW = "instruction string, input string, output string"

SAMPLES = (
    "run_file string, sample_pos bigint, key bigint, prompt string, response string, "
    "instruction_id_list array<string>, kwargs array<string>"
)
